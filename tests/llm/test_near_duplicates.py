from __future__ import annotations

import random
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from precinct.llm import near_duplicates as near_duplicates_module
from precinct.llm.components import connected
from precinct.llm.near_duplicates import (
    bands_for,
    drop_near_duplicates,
    near_duplicates,
    shared_counts,
)


def group_texts(seed: int):
    """Base texts with exact copies, near copies of several distances, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(120)]
        texts += [" ".join(base)] * rng.randrange(1, 4)
        for _ in range(8):
            near = list(base)
            for _ in range(rng.randrange(1, 6)):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near).upper() if rng.random() < 0.2 else " ".join(near))
    return texts + ["a b c", "A b, c!", "x", "", None, "!!"]


def check(found, docs):
    links, roots = brute.near_duplicates(docs)
    by_id = {row.doc_id: row for row in found.select("row.doc_id", "n_links", "class_id").collect()}
    assert len(by_id) == len(docs)
    assert [by_id[i].n_links for i, _ in docs] == links
    least = {}
    for (i, _), root in zip(docs, roots):
        least[root] = min(i, least.get(root, i))
    assert [by_id[i].class_id for i, _ in docs] == [least[root] for root in roots]


@pytest.mark.parametrize("blocks", [{}, {"block_nodes": 3}, {"block_grams": 150}])
def test_links_and_classes_equal_all_pairs(spark, blocks):
    docs = list(enumerate(group_texts(1)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    check(near_duplicates(frame, recall=0.9999999, **blocks), docs)


def test_recall_of_the_bands():
    assert bands_for(0.8, 6, 0.999) == 23
    for rows in (2, 4, 8):
        bands = bands_for(0.8, rows, 0.99)
        assert 1 - (1 - 0.8**rows) ** bands >= 0.99 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_shared_counts_of_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30)) for _ in range(7)] + [np.array([999])]
    for chunk in (4, 2048):
        counts = shared_counts(sets, chunk)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i != j:
                    assert counts[i, j] == len(set(a) & set(b))


def test_trouble(trouble, nothing):
    rows = near_duplicates(trouble).select("row.*", "n_links", "class_id", "n_grams").collect()
    assert len(rows) == len(brute.TROUBLE)
    by_id = {row.doc_id: row for row in rows if row.doc_id is not None}
    assert by_id[1].n_links == 2 and by_id[7].n_links == 2 and by_id[7].class_id == 1
    assert by_id[2].n_grams == 0 and by_id[3].n_links == 0 and by_id[5].n_grams == 1
    assert near_duplicates(nothing).count() == 0


def test_one_document_of_each_class_stays(trouble, nothing):
    kept = drop_near_duplicates(trouble)
    assert kept.columns == trouble.columns
    ids = sorted((row.doc_id is None, row.doc_id or 0) for row in kept.select("doc_id").collect())
    assert ids == [(False, i) for i in (1, 2, 3, 4, 5, 6)] + [(True, 0)] * 2
    assert drop_near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)]
    edges += [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    found = connected(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b", "test")
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = {row.node: row.root for row in found.collect()}
    assert rows == {k: root(k) for k in parent}
    assert found.count() == found.select("node").distinct().count()


def test_a_large_group_makes_no_pairs(spark):
    base = " ".join(f"w{k}" for k in range(80))
    docs = spark.range(1_200).select(
        F.col("id").alias("doc_id"), F.concat(F.lit(base), F.lit(" end"), F.col("id")).alias("text")
    )
    row = near_duplicates(docs).agg(F.min("n_links"), F.max("n_links"), F.count_distinct("class_id")).first()
    assert tuple(row) == (1_199, 1_199, 1)


def test_repeated_rows_reach_a_comparison_once_a_task(spark, monkeypatch, tmp_path):
    """3,000 equal rows and one near copy: what the verifier gets is counted by its own output."""
    base = " ".join(f"w{k}" for k in range(80))
    docs = spark.range(3_001).select(
        F.when(F.col("id") > 0, 5).otherwise(6).cast("long").alias("doc_id"),
        F.when(F.col("id") > 0, F.lit(base)).otherwise(F.lit(base + " end")).alias("text"),
    )
    reader = near_duplicates_module._gram_reader
    folder = str(tmp_path)

    def counting(n):
        read = reader(n)

        def run(batches):
            rows = 0
            for batch in read(batches):
                rows += batch.num_rows
                yield batch
            (Path(folder) / uuid.uuid4().hex).write_text(str(rows))

        return run

    monkeypatch.setattr(near_duplicates_module, "_gram_reader", counting)
    found = near_duplicates(docs).groupBy("row.doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("n_links").alias("low"), F.max("n_links").alias("high"),
        F.max("class_id").alias("class_id"),
    )
    rows = {r.doc_id: (r.rows, r.low, r.high, r.class_id) for r in found.collect()}
    assert rows == {5: (3_000, 3_000, 3_000, 5), 6: (1, 3_000, 3_000, 5)}
    counts = [int(p.read_text()) for p in Path(folder).iterdir()]
    assert 2 <= sum(counts) <= len(counts) + 1 and max(counts) <= 2
