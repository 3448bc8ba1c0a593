"""URL filters as a temporal list join, in SQL functions only.

Lists change over time: entries are added and removed on dates. The dated events become
validity intervals, and every capture of a page is judged by the entries that were active on
the day it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.llm.tables import column, staged

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty where there is none, null for null."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def list_keys(url: Column) -> Column:
    """All list entries that would match a URL.

    ``d:`` and the host or any parent domain of it; ``p:``, the host and any leading part of
    the path that ends before a slash or at its end, query and fragment left out.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")),
    )
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    paths = F.transform(
        segments,
        lambda s, k: F.concat(
            F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, k + 1), "/")
        ),
    )
    return F.when(host != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def validity(events: DataFrame) -> DataFrame:
    """Intervals [since, until) from dated events (list, entry, day, action).

    ``action`` is ``add`` or ``remove``. The latest event on or before a day decides; on one
    day an add outweighs a remove. Repeated events change nothing, a remove of what is not
    listed neither. An entry that is never removed has a null ``until``. Events with a null
    in any of the four columns, or another action, are left out.
    """
    known = events.select("list", "entry", F.col("day").cast("date").alias("day"), "action")
    daily = (
        known.dropna()
        .where(F.col("action").isin("add", "remove"))
        .groupBy("list", "entry", "day")
        .agg(F.max((F.col("action") == "add").cast("int")).alias("listed"))
    )
    order = Window.partitionBy("list", "entry").orderBy("day")
    return (
        daily.withColumn("was", F.lag("listed").over(order))
        .where(F.col("was").isNull() | (F.col("was") != F.col("listed")))
        .withColumn("until", F.lead("day").over(order))
        .where("listed = 1")
        .select("list", "entry", F.col("day").alias("since"), "until")
    )


def filter_captures(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Judge ``captures`` (url, fetched) by the lists ``block`` and ``allow`` in ``events``.

    Adds ``host``, ``n_active`` (active entries that match), ``verdict`` and ``entry``. The
    longest matching entry decides, an allow entry before a block entry of the same length;
    without one the verdict is ``none``. Columns of ``captures`` with those names are
    replaced.

    Distinct pairs of URL and day are judged once, however many captures they have. Each pair
    is spread over its keys, so a join on equal keys finds the entries and a comparison of
    days does the rest. A host or parent domain with most of the captures is a hot key that
    Spark splits, both sides of the joins coming from a shuffle. A null URL or day, or a URL
    without a host, matches nothing; every capture keeps its row.
    """
    packed = captures.select(
        F.struct(*[column(c) for c in captures.columns]).alias("capture"),
        column("url").alias("url"),
        column("fetched").cast("date").alias("fetched"),
    )
    targets = packed.select("url", "fetched").dropna().distinct()
    keys = staged(targets, "targets").withColumn("entry", F.explode(list_keys(F.col("url"))))
    active = keys.join(staged(validity(events), "validity"), "entry").where(
        (F.col("fetched") >= F.col("since"))
        & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    )
    weight = F.struct(
        F.length("entry").alias("length"), (F.col("list") == "allow").alias("allow"), "entry", "list"
    )
    verdicts = staged(
        active.groupBy("url", "fetched")
        .agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("best"))
        .select(
            "url",
            "fetched",
            F.struct("n", F.col("best.list").alias("verdict"), F.col("best.entry").alias("entry")).alias("found"),
        ),
        "verdicts",
    )
    joined = packed.join(verdicts, ["url", "fetched"], "left")
    results = {
        "host": host_of(F.col("url")),
        "n_active": F.coalesce(F.col("found.n"), F.lit(0)).cast("long"),
        "verdict": F.coalesce(F.col("found.verdict"), F.lit("none")),
        "entry": F.col("found.entry"),
    }
    others = [F.col("capture")[c].alias(c) for c in captures.columns if c not in results]
    return joined.select(*others, *[value.alias(name) for name, value in results.items()])
