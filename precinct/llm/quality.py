"""Quality rules: text statistics and a decision list learned from labelled documents.

SQL functions only. The list is grown by sequential covering: one rule after another, each
a conjunction of thresholds that separates low-quality documents from the others, grown on
two thirds of the labelled documents, pruned on the last third, and turned into one
``CASE WHEN`` expression. Learning looks at counts of binned statistics, never at texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.llm.tables import column, space_words, staged, text_of

SYMBOLS = r"[#*$%&|<>]"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_bangs")

# Statistics rules may use, with fixed thresholds: the same at every size of the input.
RATIO_STEPS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
FEATURES = {
    "words": ("n_words", None, (20, 50, 75, 100, 150, 200, 400, 800, 1600, 3200, 6400)),
    "word_length": ("word_chars", "n_words", (2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 12)),
    "symbols_per_word": ("n_symbols", "n_words", RATIO_STEPS + (1, 2)),
    "repeated_lines": ("n_dup_lines", "n_lines", RATIO_STEPS),
    "repeated_words": ("n_repeat_words", "n_words", RATIO_STEPS),
    "upper_case": ("n_upper", "word_chars", RATIO_STEPS),
    "exclamations": ("n_bangs", "n_words", RATIO_STEPS + (1, 2)),
    "words_per_line": ("n_words", "n_lines", (1, 1.5, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64)),
}


def repeated_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from the windows' hashes."""
    placed = F.sort_array(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i")))
    )

    def starts(ordered: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            before = x["h"] == F.get(ordered, k - 1)["h"]
            after = x["h"] == F.get(ordered, k + 1)["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.filter(ordered, repeated)

    # A one-element array binds the sorted windows to a name, so they are sorted once.
    found = F.transform(F.array(placed), starts)[0]
    covered = F.flatten(
        F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        F.size(F.array_distinct(covered))
    )


def text_statistics(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` (the columns in ``keep``) and the statistics of every whole text, as longs.

    Null and empty texts have no words: all statistics are 0. Repeated rows each give a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    window = F.when(
        F.size("words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.xxhash64(
                F.get(F.col("words"), i), F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)
            ),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    statistics = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeated_words(F.col("hashes")),
        "n_lines": F.size("lines"),
        "n_upper": F.regexp_count(text, F.lit("[A-Z]")),
        "n_bangs": F.regexp_count(text, F.lit("!")),
    }
    return (
        docs.select(
            F.struct(*[column(name) for name in keep]).alias("row"), text_of(docs).alias("text")
        )
        .withColumns({"words": space_words(text), "lines": lines})
        .withColumn("hashes", window)
        .select("row", *[value.cast("long").alias(name) for name, value in statistics.items()])
    )


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature(name: str) -> Column:
    """A statistic as rules see it; a ratio with nothing below the line is 0."""
    value, per, _ = FEATURES[name]
    if per is None:
        return F.col(value).cast("double")
    return F.coalesce(F.try_divide(F.col(value).cast("double"), F.col(per)), F.lit(0.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    bin: int

    @property
    def threshold(self) -> float:
        return FEATURES[self.feature][2][self.bin - 1]

    def on_bins(self) -> Column:
        value = F.col(self.feature)
        return value >= self.bin if self.at_least else value < self.bin

    def on_statistics(self) -> Column:
        value = feature(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _all(conditions: Sequence[Column]) -> Column:
    whole = F.lit(True)
    for condition in conditions:
        whole = whole & condition
    return whole


def _any(rules: Sequence[Rule]) -> Column:
    either = F.lit(False)
    for rule in rules:
        either = either | _all([c.on_bins() for c in rule])
    return either


def labelled_cells(labelled: DataFrame, key: Column) -> DataFrame:
    """Labelled statistics counted by their bins: (bins, prune, bad, good).

    ``labelled`` has the statistics and ``quality`` (0 is low). A third of the documents, by
    the hash of ``key``, is kept for pruning. All labelled documents are counted.
    """
    bins = {
        name: sum(((feature(name) >= t).cast("int") for t in steps), F.lit(0))
        for name, (_, _, steps) in FEATURES.items()
    }
    return (
        labelled.where(F.col("quality").isin(0, 1))
        .select(
            *[value.alias(name) for name, value in bins.items()],
            (F.pmod(F.xxhash64(key), F.lit(3)) == 0).alias("prune"),
            "quality",
        )
        .groupBy(*FEATURES, "prune")
        .agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"))
    )


def _best(cells: DataFrame, min_bad: int) -> Condition | None:
    """The condition with the highest information gain over the given cells."""
    named = F.explode(
        F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in FEATURES])
    )
    counts = (
        cells.select(named.alias("x"), "bad", "good")
        .groupBy("x.feature", "x.bin")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .collect()  # one row per feature and bin
    )
    table = {(r["feature"], r["bin"]): (r["bad"], r["good"]) for r in counts}
    best, best_gain = None, 0.0
    for name, (_, _, steps) in FEATURES.items():
        by_bin = [table.get((name, b), (0, 0)) for b in range(len(steps) + 1)]
        all_bad, all_good = sum(b for b, _ in by_bin), sum(g for _, g in by_bin)
        if not all_bad or not all_good:
            return None
        before = log2(all_bad / (all_bad + all_good))
        for cut in range(1, len(steps) + 1):
            low = (sum(b for b, _ in by_bin[:cut]), sum(g for _, g in by_bin[:cut]))
            high = (all_bad - low[0], all_good - low[1])
            for at_least, (bad, good) in ((True, high), (False, low)):
                if bad >= min_bad:
                    gain = bad * (log2(bad / (bad + good)) - before)
                    if gain > best_gain + 1e-9:
                        best, best_gain = Condition(name, at_least, cut), gain
    return best


def learn_rules(
    cells: DataFrame,
    *,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_bad: int = 5,
    min_precision: float = 0.75,
) -> list[Rule]:
    """The ordered rules that mark low quality, by sequential covering over counted cells.

    A rule grows by the condition with most information gain until it covers no good
    document, then loses trailing conditions as long as (bad - good) / (bad + good) over the
    pruning cells does not fall. The first rule whose precision there is below
    ``min_precision`` ends the list, as does running out of labels. Each step is one
    aggregate, of which one row per feature and bin reaches the driver.
    """
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = cells.where(~_any(rules))
        growing: list[Condition] = []
        while len(growing) < max_conditions:
            covered = left.where(~F.col("prune") & _all([c.on_bins() for c in growing]))
            condition = _best(covered, min_bad)
            if condition is None or condition in growing:
                break
            growing.append(condition)
        if not growing:
            break
        tested = left.where("prune").agg(
            *[
                F.coalesce(F.sum(F.when(_all([c.on_bins() for c in growing[:n]]), F.col(kind))), F.lit(0))
                for n in range(1, len(growing) + 1)
                for kind in ("bad", "good")
            ]
        ).first()
        worth = [
            ((tested[2 * n] + 1) / (tested[2 * n] + tested[2 * n + 1] + 2), -n, tested[2 * n])
            for n in range(len(growing))
        ]
        precision, size, bad = max(worth)
        if precision < min_precision or not bad:
            break
        rules.append(tuple(growing[: 1 - size]))
    return rules


def decision(rules: Sequence[Rule]) -> Column:
    """The list as one conditional expression: false where a rule holds, else true."""
    if not rules:
        return F.lit(True)
    chain = F
    for rule in rules:
        chain = chain.when(_all([c.on_statistics() for c in rule]), F.lit(False))
    return chain.otherwise(F.lit(True))


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, *, keep: Sequence[str] = ("doc_id",)
) -> tuple[DataFrame, list[Rule]]:
    """Statistics, ``base_failed`` and ``kept`` of every document, and the rules learned.

    ``keep`` names the columns to carry along in ``row``, ``doc_id`` among them.
    ``labels`` has doc_id and quality (1 good, 0 low; other values and nulls are ignored).
    Several labels of a document all count. Texts are read once: the statistics are staged,
    and both learning and the verdicts read those. Without usable labels the list is empty
    and ``kept`` is the negation of ``base_failed``.
    """
    statistics = staged(
        text_statistics(docs, keep=keep).withColumn("key", F.col("row")["doc_id"]), "statistics"
    )
    labelled = statistics.drop("row").join(
        labels.select(column("doc_id").alias("key"), "quality").where(F.col("key").isNotNull()), "key"
    )
    rules = learn_rules(staged(labelled_cells(labelled, F.col("key")), "cells"))
    verdicts = statistics.drop("key").withColumn("base_failed", base_failed())
    return verdicts.withColumn("kept", ~F.col("base_failed") & decision(rules)), rules
