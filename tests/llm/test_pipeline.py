"""The pipeline on the test tables, every stage against a plain version of its decision."""

from __future__ import annotations

from collections import defaultdict

import pytest

import brute
import corpus_pipeline
from precinct.llm import decontaminate, near_duplicates, secrets
from precinct.llm.tables import staged


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """What goes into each stage and what comes out at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200)
    tables = [staged(docs, "start")]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], sf_dir), "step"))
    return tables


def by_id(table):
    return {row.doc_id: row for row in table.collect()}


def test_all_but_the_last_keep_the_columns(steps):
    columns = steps[0].columns
    assert [t.columns for t in steps[1:5]] == [columns] * 4
    assert steps[5].columns == [*columns, "copy"]


def test_language_stage_keeps_clean_documents(steps):
    before, after = by_id(steps[0]), by_id(steps[1])
    assert set(after) <= set(before) and len(after) >= 0.98 * len(before)


def test_language_stage_without_labels_keeps_texts_with_letters(spark, sf_dir):
    rows = [(1, "words", None, "a", 5), (2, "12 34", None, "a", 5), (3, None, None, "a", 0), (4, "слова", None, "a", 5)]
    docs = spark.createDataFrame(rows, brute.DOCUMENTS)
    kept = corpus_pipeline.keep_known_languages(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4}


def test_least_score_grows_from_chance():
    assert [round(corpus_pipeline.least_score(k), 3) for k in (1, 2, 4, 10)] == [1.0, 0.567, 0.35, 0.22]
    assert corpus_pipeline.least_score(1) < 1


def test_one_document_of_each_class_stays(steps):
    before, after = by_id(steps[1]), by_id(steps[2])
    docs = sorted((k, row.text) for k, row in before.items())
    _, roots = brute.near_duplicates(docs)
    least = {}
    for (k, _), root in zip(docs, roots):
        least[root] = min(k, least.get(root, k))
    assert set(after) == set(least.values())


def test_contaminated_documents_go(spark, sf_dir, steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {
        k for k, words, hit, _ in brute.contamination([(k, r.text) for k, r in before.items()], items)
        if not (hit and 20 * hit >= words)
    }
    assert set(after) == clean


def test_secrets_are_replaced(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    assert set(before) == set(after)
    changed = 0
    for k, row in before.items():
        if brute.base_secrets(row.text):
            changed += 1
            assert "[secret]" in after[k].text and not brute.base_secrets(after[k].text)
            assert after[k].n_chars == len(after[k].text)
    same = {k for k in before if before[k].text == after[k].text}
    assert len(same) >= len(before) - changed - 2


def test_mix_meets_the_targets(steps):
    before = by_id(steps[4])
    sizes, taken, copies = defaultdict(int), defaultdict(int), defaultdict(set)
    size = {k: len(brute.SPACE.findall(row.text or "")) for k, row in before.items()}
    for k, row in before.items():
        sizes[row.source] += size[k]
    for row in steps[5].collect():
        taken[row.source] += size[row.doc_id]
        copies[row.doc_id].add(row.copy)
        assert row.text == before[row.doc_id].text
    assert all(found == set(range(1, len(found) + 1)) and len(found) <= 3 for found in copies.values())
    largest = {s: max(size[k] for k in before if before[k].source == s) for s in sizes}
    for source, target in brute.targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(0.05 * target, largest[source] / 2)


def test_stages_survive_troubled_and_empty_tables(spark, sf_dir, trouble, nothing):
    for docs in (trouble, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, sf_dir).columns == docs.columns
            stage(spark, docs, sf_dir).count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, trouble, sf_dir)
    assert mixed.columns == [*trouble.columns, "copy_"]
    assert {r["copy"] for r in mixed.collect()} == {"mine"}


def test_stages_call_the_operators_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language identification", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources",
    ]
    assert corpus_pipeline.ORACLE_SQL is None
    assert near_duplicates.THRESHOLD == 0.8 and near_duplicates.N == 5 and decontaminate.WINDOW == 13
    assert secrets.KINDS[:3] == ("assign", "access", "hex")
