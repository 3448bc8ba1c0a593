from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from precinct.llm import quality
from precinct.llm.queries import op7_quality_rules

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LABELS = "doc_id bigint, quality int, toxic int"


def test_statistics_equal_a_plain_count(spark):
    rng = random.Random(6)
    vocabulary = ["a", "b", "ü", "#x", "x|", "<b>", "$", "word"]
    texts = [
        "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t", " ", "\r\n"]) for _ in range(rng.randrange(80)))
        for _ in range(60)
    ] + [None, "", "\n\n", "a", "a a a a", "x y z x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.row.doc_id: tuple(r[n] for n in NAMES) for r in quality.text_statistics(docs).collect()}
    assert rows == {k: brute.statistics(t) for k, t in enumerate(texts)}


def test_query_on_the_test_tables(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = brute.statistics(texts[r.doc_id])
        assert tuple(r[n] for n in NAMES) == own
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r.base_failed and r.kept)


@pytest.fixture(scope="module")
def study(spark):
    """Low quality is many symbols, or short words with repeated lines; one label in 20 is wrong."""
    rng = random.Random(7)
    docs, labels = [], []
    for k in range(400):
        kind = rng.choice(["good", "good", "symbols", "lines"])
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) + str(j) for j in range(80)]
        if kind == "symbols":
            words = [w + "#$" for w in words]
        text = " ".join(words)
        if kind == "lines":
            text += "\nsame line" * 20
        docs.append((k, text, kind))
        low = (kind != "good") != (rng.random() < 0.05)
        labels.append((k, 0 if low else 1, None))
    return spark.createDataFrame(docs, "doc_id bigint, text string, kind string"), spark.createDataFrame(labels, LABELS)


def test_rules_find_what_makes_quality_low(study):
    docs, labels = study
    verdicts, rules = quality.quality_verdicts(docs, labels, keep=("doc_id", "kind"))
    assert 1 <= len(rules) <= 4
    counts = {(r.kind, r.kept): r.n for r in verdicts.groupBy("row.kind", "kept").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {("good", True), ("symbols", False), ("lines", False)}


def test_decision_is_one_ordered_expression(study):
    rule = (quality.Condition("words", True, 3), quality.Condition("upper_case", False, 2))
    text = str(quality.decision([rule]))
    assert "CASE WHEN" in text and str(rule[0]) == "words >= 75"
    assert "true" in str(quality.decision([])).lower()


def test_trouble(spark, trouble, nothing):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, None, 1), (None, 0, 0), (5, 7, 0)], LABELS)
    verdicts, rules = quality.quality_verdicts(trouble, labels)
    assert rules == [] and verdicts.count() == len(brute.TROUBLE)
    assert not any(r.kept for r in verdicts.where("base_failed").collect())
    assert quality.quality_verdicts(nothing, labels)[0].count() == 0
    none, rules = quality.quality_verdicts(trouble, spark.createDataFrame([], LABELS))
    assert rules == [] and none.count() == len(brute.TROUBLE)
    plan = verdicts._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
