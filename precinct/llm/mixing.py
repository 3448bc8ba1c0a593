"""Mixing sources to target weights by entropy balancing, in SQL functions only.

Every document gets a rate, the number of times the mix should take it. Among all rates
whose tokens meet the target of each source, those closest to 1 in relative entropy are
exponentially tilted: rate = exp(tilt * size / mean size), cut at the cap. The tilts are the
solution of a convex dual problem, found by Newton steps over the distribution of sizes. The
rates are then rounded to whole copies.

Rounding adds a hash of the document, uniform in [0, 1), and takes the whole part, which is
right on average. A common shift per source, found by search, then moves the total as close
to the target as whole documents allow. Shifts are integers and apply to each document on
its own, so the outcome is the same in every run and no order of documents is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.llm.tables import column, staged, text_of

CYCLE = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"

# Rates, hashes and shifts count in this unit: integers make sums exact in any order.
UNIT = 1 << 20
BUCKET = 10  # bits of a shift that the first of two passes leaves open
LEVELS = 3
MAX_STEPS = 60
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(table: DataFrame, name: str) -> DataFrame:
    """Add ``place``: 0, 1, ... in the order of ``name``, by code point, null last.

    Sorted by range over all tasks; only the row counts of the partitions meet in one.
    """
    numbered = staged(
        table.orderBy(F.asc_nulls_last(name)).withColumn("id", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("id", 33)
    offsets = (
        numbered.groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
        .select("part", "before")
    )
    place = F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("part", part)
        .join(offsets, "part")
        .withColumn("place", place)
        .drop("id", "part", "before")
    )


def token_targets(
    sources: DataFrame, *, cycle: Sequence[int] = CYCLE, cap: int = CAP
) -> DataFrame:
    """Add ``place``, ``weight`` and ``target`` to ``sources`` (source, source_size).

    The sizes of all sources are shared by weight. A target stops at ``cap`` times its
    source's size; what is left over goes to the others by weight, until none is above. The
    share per weight only ever rises, so one number describes each round, and a round is one
    aggregate over the sources.
    """
    weight = F.get(F.array(*[F.lit(w) for w in cycle]), (F.col("place") % len(cycle)).cast("int"))
    wide = staged(in_order(sources, "source").withColumn("weight", weight), "sources")
    big = "decimal(38,0)"
    limit = F.col("source_size").cast(big) * cap

    def capped(free: int, weights: int) -> Column:
        return F.col("weight").cast(big) * F.lit(free).cast(big) > limit * weights

    total, weights = wide.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    share = (total, weights)
    while share[1]:
        above = capped(*share)
        taken, left = wide.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0).cast(big)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        after = (total - int(taken), left)
        if after == share:
            break
        share = after
    open_target = F.col("weight") * F.lit(float(share[0])) / F.lit(float(share[1] or 1))
    target = F.when(capped(*share) if share[1] else F.lit(True), limit.cast("double"))
    return wide.withColumn("target", target.otherwise(open_target))


def rate_units(cap: int = CAP) -> Column:
    """The rate of a document of ``size`` in its source, in units."""
    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean_size"), F.lit(50.0)))
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(tilted, F.lit(float(cap))))
    return F.round(F.coalesce(rate, F.lit(1.0)) * UNIT).cast("long")


def balance(sizes: DataFrame, targets: DataFrame, *, cap: int = CAP) -> DataFrame:
    """Add to ``targets`` the tilt that meets each source's target: (tilt, mean_size, full).

    ``sizes`` counts documents (``n``) by ``place`` and ``size``. Every step is one aggregate
    over that table for all sources at once. Newton's step is taken where it stays between
    the bounds found so far, and the middle of them otherwise, so it cannot run away.
    ``full`` marks sources whose target is the cap itself.
    """
    mean = F.try_divide(F.sum(F.col("n") * F.col("size")).cast("double"), F.sum("n"))
    state = targets.join(sizes.groupBy("place").agg(mean.alias("mean_size")), "place").select(
        *targets.columns,
        F.when(F.col("mean_size") > 0, F.col("mean_size")).otherwise(1.0).alias("mean_size"),
        (F.col("target") >= F.col("source_size") * cap).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
        F.lit(1.0).alias("error"),
    )
    state = staged(state, "tilts")
    x = F.col("size") / F.col("mean_size")
    rate = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
    tokens = F.col("n") * F.col("size")
    for _ in range(MAX_STEPS):
        sums = (
            sizes.join(state.select("place", "mean_size", "tilt"), "place")
            .groupBy("place")
            .agg(
                F.sum(tokens * F.least(rate, F.lit(float(cap)))).alias("taken"),
                F.sum(F.when(rate < cap, tokens * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("taken") - F.col("target")
        low = F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        middle = (F.col("low2") + F.col("high2")) / 2
        wider = F.when(F.col("high2").isNull(), F.col("tilt") + 1 + F.abs("tilt")).otherwise(
            F.col("tilt") - 1 - F.abs("tilt")
        )
        inside = (newton > F.coalesce(F.col("low2"), newton - 1)) & (
            newton < F.coalesce(F.col("high2"), newton + 1)
        )
        step = F.when(inside, newton).otherwise(F.coalesce(middle, wider))
        error = F.when(F.col("full"), 0.0).otherwise(
            F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        )
        done = error < TOLERANCE
        moved = state.join(sums, "place").withColumns({"low2": low, "high2": high})
        state = staged(
            moved.select(
                *targets.columns,
                "mean_size",
                "full",
                F.when(done, F.col("tilt")).otherwise(step).alias("tilt"),
                F.col("low2").alias("low"),
                F.col("high2").alias("high"),
                error.alias("error"),
            ),
            "tilts",
        )
        worst = state.agg(F.max("error")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
    else:
        raise RuntimeError(f"the tilts did not settle in {MAX_STEPS} steps")
    # The last digits depend on the order of sums; dropping them makes runs agree.
    return state.select(
        *targets.columns, "mean_size", "full", F.round("tilt", 6).alias("tilt")
    )


def _open_shift() -> Column:
    """The largest shift found so far that is open to the document's size."""
    return F.aggregate(
        "shifts",
        F.lit(-4 * UNIT).cast("long"),
        lambda most, s: F.when(F.col("size") <= s["limit"], F.greatest(most, s["shift"])).otherwise(most),
    )


def _whole(shift: Column, cap: int) -> Column:
    rounded = F.floor((F.col("units") + shift) / F.lit(UNIT))
    return F.greatest(F.lit(0), F.least(F.lit(cap), rounded)).cast("long")


def copies(cap: int = CAP) -> Column:
    """Whole copies: rate plus hash plus the largest shift open to the document's size."""
    return _whole(_open_shift(), cap)


def search_shifts(documents: DataFrame, tilts: DataFrame, *, cap: int = CAP) -> DataFrame:
    """Add ``shifts`` to ``tilts``: (limit, shift) pairs, looser ones for smaller documents.

    ``documents`` has one narrow row each: place, size and units (rate plus hash). A document
    gains its c-th copy at the shift ``c * UNIT - units``, so the largest shift that keeps a
    source's tokens within its target is a weighted quantile of those. It is found in two
    passes: by buckets of shifts, then within the bucket that crosses the target. What is
    still missing is less than one document; the next shift is for documents no larger than
    that gap, and so on.
    """
    pair = "array<struct<limit:bigint,shift:bigint>>"
    found = staged(
        tilts.select("*", F.array().cast(pair).alias("shifts"), F.lit(1 << 62).alias("limit")),
        "shifts",
    )
    gains = F.array(*[F.lit(c * UNIT) - F.col("units") for c in range(1, cap + 1)])
    upto = Window.partitionBy("place").orderBy(F.asc_nulls_first("step"))
    so_far = F.sum("tokens").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    for _ in range(LEVELS):
        rows = (
            documents.join(found.select("place", "limit", "shifts"), "place")
            .withColumn("before", _open_shift())
            .withColumn("gains", F.when(F.col("size") <= F.col("limit"), F.filter(gains, _above)))
        )
        # Null stands for what a source takes before any further shift.
        taken = rows.select("place", F.lit(None).cast("long").alias("step"), (F.col("size") * _whole(F.col("before"), cap)).alias("tokens"))
        gained = rows.select("place", F.explode("gains").alias("step"), F.col("size").alias("tokens"))
        coarse = staged(
            taken.unionByName(gained.withColumn("step", F.shiftright("step", BUCKET)))
            .groupBy("place", "step")
            .agg(F.sum("tokens").alias("tokens")),
            "buckets",
        )
        fits = F.col("sum") <= F.col("target")
        targets = found.select("place", "target")
        crossing = staged(
            coarse.withColumn("sum", so_far)
            .join(targets, "place")
            .groupBy("place")
            .agg(
                F.coalesce(F.max(F.when(fits, F.col("sum"))), F.lit(0)).alias("below"),
                F.min(F.when(~fits, F.col("step"))).alias("bucket"),
            ),
            "crossing",
        )
        inside = (
            gained.join(crossing, "place")
            .where(F.shiftright("step", BUCKET) == F.col("bucket"))
            .groupBy("place", "step")
            .agg(F.sum("tokens").alias("tokens"))
            .withColumn("sum", so_far)
            .join(targets, "place")
            .join(crossing, "place")
            .withColumn("sum", F.col("sum") + F.col("below"))
            .where(fits)
            .groupBy("place")
            .agg(F.max("step").alias("step"), F.max("sum").alias("sum"))
        )
        start = F.shiftleft("bucket", BUCKET) - 1
        shift = F.coalesce("step", start, F.lit(1 << 40)).cast("long")
        found = staged(
            found.join(crossing, "place")
            .join(inside, "place", "left")
            .select(
                *tilts.columns,
                F.array_append("shifts", F.struct("limit", shift.alias("shift"))).alias("shifts"),
                F.floor(F.col("target") - F.coalesce("sum", "below")).cast("long").alias("limit"),
            ),
            "shifts",
        )
    return found.drop("limit")


def _above(shift: Column) -> Column:
    return shift > F.col("before")


def mix(
    docs: DataFrame,
    *,
    keep: Sequence[str] = ("doc_id",),
    cycle: Sequence[int] = CYCLE,
    cap: int = CAP,
) -> DataFrame:
    """How often the mix takes each document of ``docs`` (doc_id, text, source).

    Returns ``row`` (the columns in ``keep``), ``size`` (words), ``source_size``, ``target``
    (of its source) and ``copies`` (0 to ``cap``). Sources weigh ``cycle`` in code-point
    order, null last, over and over. Nothing is limited in number: sources, sizes and
    documents are only ever aggregated by map-side sums, so a source with most of the rows
    is no hot spot, and documents meet their source's numbers in a join Spark can split.

    Null and empty texts have size 0 and are taken once. A source without words has target
    0. Repeated rows hash alike and are taken alike. An empty table gives no rows.
    """
    text = text_of(docs)
    hashed = F.pmod(F.xxhash64(column("doc_id"), text), F.lit(UNIT))
    measured = docs.select(
        F.struct(*[column(name) for name in keep]).alias("row"),
        column("source").cast("string").alias("source"),
        word_count(text).alias("size"),
        hashed.alias("hashed"),
    )
    narrow = staged(measured.drop("row"), "sizes")
    by_size = staged(
        narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "by-size"
    )
    targets = token_targets(
        by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")),
        cycle=cycle,
        cap=cap,
    )
    targets = staged(targets, "targets")
    named = targets.select(F.col("source").alias("named"), "place")
    same = F.col("source").eqNullSafe(F.col("named"))
    sizes = staged(by_size.join(named, same).select("place", "size", "n"), "sizes-by-source")
    tilts = balance(sizes, targets, cap=cap)

    def with_source(documents: DataFrame, table: DataFrame) -> DataFrame:
        renamed = table.withColumnRenamed("source", "named")
        return documents.join(renamed, F.col("source").eqNullSafe(F.col("named")))

    units = rate_units(cap) + F.col("hashed")
    tilts = staged(tilts, "balanced")
    documents = staged(
        with_source(narrow, tilts).select("place", "size", units.alias("units")), "units"
    )
    shifts = search_shifts(documents, tilts, cap=cap)
    return (
        with_source(measured, shifts)
        .withColumn("units", units)
        .select(
            "row",
            "size",
            "source_size",
            "target",
            F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(copies(cap)).alias("copies"),
        )
    )
