"""Document fingerprints: threshold-scaled sketches, in SQL functions only.

A text's 5-word shingles are hashed to 48 bits, and every hash below a fixed fraction of the
hash space is retained, whatever the length of the text. So the sketches of a sentence and of
a book are samples by one rule: what they share of the retained hashes estimates containment
either way, and the sketch of a union is the union of the sketches.

A text with few shingles would retain next to none. Its sketch goes on to its ``LEAST``
smallest hashes, and is marked complete if those are all. Every hash up to the last retained
one is known then, so two sketches are compared as far as both reach, and merging stays exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.llm.tables import column, staged, text_of

N = 5
FRACTION = 1 / 8
LEAST = 32
DIGITS = 12  # hexadecimal digits of a hash
# Documents that follow one another in one task.
BLOCK = 256

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALL, _LOW = "all:", "low:"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; a plain name would repeat the work."""
    return F.transform(F.array(value), body)[0]


def bound(fraction: float = FRACTION) -> str:
    """The hash that a fraction of all hashes lies below."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    return format(int(fraction * 16**DIGITS), f"0{DIGITS}x")


def shingle_hashes(text: Column, n: int = N) -> Column:
    """Sorted hashes of the distinct shingles; fewer words, but not none, are one shingle."""
    words = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
        shingles = F.transform(
            starts, lambda k: F.substring(F.md5(F.array_join(F.slice(w, k, n), " ")), 1, DIGITS)
        )
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
            F.sort_array(F.array_distinct(shingles))
        )

    return _let(words, hashes)


def _packed(hashes: Column, complete: Column, fraction: float, least: int) -> Column:
    """The sketch of sorted hashes, of which ``complete`` says whether they are all."""
    below = F.size(F.filter(hashes, lambda h: h < bound(fraction)))
    kept = F.greatest(below, F.least(F.size(hashes), F.lit(least)))
    head = F.when(complete & (kept == F.size(hashes)), _ALL).otherwise(_LOW)
    return F.concat(head, F.array_join(F.slice(hashes, F.lit(1), kept), ","))


def fingerprint(text: Column, *, n: int = N, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of a whole text, as a string that depends on nothing but its shingles.

    Null and empty texts, and texts without words, have the sketch ``all:``.
    """
    hashes = shingle_hashes(F.coalesce(text, F.lit("")), n)
    return _let(hashes, lambda h: _packed(h, F.lit(True), fraction, least))


def retained(sketch: Column) -> Column:
    """The hashes of a sketch, sorted."""
    return F.filter(F.split(F.substring(sketch, len(_ALL) + 1, 1 << 30), ","), lambda h: h != "")


def _reach(sketch: Column, fraction: float) -> Column:
    """All of a text's hashes below this are in its sketch; a letter above all digits if any is."""
    last = F.concat(F.substring(sketch, -DIGITS, DIGITS), F.lit("0"))
    whole = sketch.startswith(_ALL)
    return F.when(whole, F.lit("g")).otherwise(F.greatest(F.lit(bound(fraction)), last))


def merge(one: Column, other: Column, *, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of two texts' shingles together."""
    reach = F.least(_reach(one, fraction), _reach(other, fraction))
    union = F.sort_array(F.array_union(retained(one), retained(other)))
    known = _let(F.struct(union.alias("all"), reach.alias("reach")), lambda s: F.filter(s["all"], lambda h: h < s["reach"]))
    whole = one.startswith(_ALL) & other.startswith(_ALL)
    return _let(known, lambda h: _packed(h, whole, fraction, least))


def _shared(one: Column, other: Column, fraction: float, measure) -> Column:
    """Compare two sketches as far as both reach."""
    parts = F.struct(
        retained(one).alias("one"),
        retained(other).alias("other"),
        F.least(_reach(one, fraction), _reach(other, fraction)).alias("reach"),
    )

    def known(s: Column) -> Column:
        return F.struct(
            F.filter(s["one"], lambda h: h < s["reach"]).alias("one"),
            F.filter(s["other"], lambda h: h < s["reach"]).alias("other"),
        )

    def counted(s: Column) -> Column:
        return F.struct(
            F.size(s["one"]).alias("one"),
            F.size(s["other"]).alias("other"),
            F.size(F.array_intersect(s["one"], s["other"])).alias("both"),
        )

    return _let(parts, lambda p: _let(known(p), lambda k: _let(counted(k), measure)))


def likeness(one: Column, other: Column, *, fraction: float = FRACTION) -> Column:
    """Estimated Jaccard similarity of two texts' shingles: 0 to 1, and 1 for equal sketches.

    Two texts without words are alike; a text without words is unlike any other.
    """
    union = lambda c: c["one"] + c["other"] - c["both"]
    share = _shared(
        one, other, fraction,
        lambda c: F.when(union(c) == 0, 0.0).otherwise(c["both"].cast("double") / F.greatest(union(c), F.lit(1))),
    )
    return F.when(one == other, 1.0).otherwise(share)


def containment(one: Column, other: Column, *, fraction: float = FRACTION) -> Column:
    """Estimated share of the first text's shingles that the second has, however long it is.

    Null if nothing of the first is within the reach of both sketches.
    """
    return _shared(one, other, fraction, lambda c: F.try_divide(c["both"].cast("double"), c["one"]))


def fingerprints(
    docs: DataFrame,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    n: int = N,
    fraction: float = FRACTION,
    least: int = LEAST,
) -> DataFrame:
    """``row`` (the columns in ``keep``) and ``fingerprint`` of every whole text of ``docs``.

    Every document keeps its row, repeated ones too, and equal texts have equal fingerprints.
    Nothing is shuffled. An empty table gives none.
    """
    made = fingerprint(text_of(docs), n=n, fraction=fraction, least=least)
    return docs.select(F.struct(*[column(name) for name in keep]).alias("row"), made.alias("fingerprint"))


def _numbered(table: DataFrame, *order: Column) -> DataFrame:
    """Add ``place``: 0, 1, ... in the given order.

    Sorted by range over all tasks; only the row counts of the partitions meet in one.
    """
    sorted_rows = staged(table.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    before = (
        sorted_rows.groupBy(part.alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    )
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_rows.withColumn("part", part).join(before, "part").withColumn("place", place).drop("part", "at", "before")


def with_next(
    docs: DataFrame, made: dict[str, Callable[[Column], Column]], *, block: int = BLOCK
) -> DataFrame:
    """Documents beside the next one in descending order of their ids; the first follows the last.

    Returns ``doc_id``, ``text``, ``next_text``, ``times``, and for each entry of ``made``, a
    function from texts, its value for the text, and with ``next_`` before the name for the next.

    Rows with equal id and text are one document that comes ``times`` times; documents of one
    id go by a digest of their texts, null ids last. Null text counts as empty.

    Places in the order come from ids and digests alone. Documents then meet by place, in
    blocks of consecutive ones, and the first of each block is also sent to the one before. So
    no task holds more than a block, whatever the ids, and repeats are reduced before that.
    """
    text = F.coalesce(text_of(docs), F.lit(""))
    name = F.coalesce(column("doc_id").cast("string"), F.lit("null"))
    key = F.md5(F.concat(name, F.lit(":"), text))
    own = docs.select(key.alias("key"), column("doc_id").alias("doc_id"), text.alias("text"))
    order = F.desc_nulls_last("doc_id"), F.asc("key")
    places = _numbered(own.select("key", "doc_id").distinct(), *order).select("key", "place")
    places = staged(places, "places")
    number = F.floor(F.col("place") / F.lit(block))
    last = F.lit((places.count() - 1) // block).cast("long")
    here = F.struct(number.alias("block"), F.col("place").alias("slot"))
    before = F.struct(
        F.when(number == 0, last).otherwise(number - 1).alias("block"), F.lit(1 << 62).alias("slot")
    )
    spots = F.when(F.col("place") % F.lit(block) == 0, F.array(here, before)).otherwise(F.array(here))
    spread = (
        own.groupBy("key")
        .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
        .join(places, "key")
        .select("doc_id", "text", "times", "place", F.inline(spots))
        .repartition("block")
    )
    following = Window.partitionBy("block").orderBy("slot")
    for added, function in made.items():
        spread = spread.withColumn(added, function(F.col("text")))
    leads = [F.lead(c).over(following).alias(f"next_{c}") for c in ("text", *made)]
    return (
        spread.select("doc_id", "text", "times", *made, *leads, "place", "slot")
        .where(F.col("slot") == F.col("place"))
        .drop("place", "slot")
    )


def repeated(table: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, in two steps, so that no array is long."""
    step = F.lit(1 << 12).cast("long")
    rounds = F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / step))
    wide = table.select("*", times.alias("_times"), F.explode(rounds).alias("_round"))
    left = F.least(F.col("_times") - F.col("_round") * step, step).cast("int")
    each = wide.select(*[column(c) for c in table.columns], F.explode(F.array_repeat(F.lit(1), left)).alias("_one"))
    return each.drop("_one")
