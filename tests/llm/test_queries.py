"""Registered queries without SQL, over the whole test tables, against plain versions."""

from __future__ import annotations

from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from precinct.llm import toxicity
from precinct.llm.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()


def test_op1_links_and_classes(spark, sf_dir, documents):
    links, roots = brute.near_duplicates([(d.doc_id, d.text) for d in documents])
    least = {}
    for d, root in zip(documents, roots):
        least[root] = min(d.doc_id, least.get(root, d.doc_id))
    found = {r.doc_id: r for r in QUERIES["op1_ngram_join"](spark, sf_dir).collect()}
    assert len(found) == len(documents)
    for d, n, root in zip(documents, links, roots):
        assert (found[d.doc_id].n_links, found[d.doc_id].class_id) == (n, least[root])


def test_op4_targets(spark, sf_dir, documents):
    size = {d.doc_id: len(brute.SPACE.findall(d.text or "")) for d in documents}
    total, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in documents:
        total[d.source] += size[d.doc_id]
        largest[d.source] = max(largest[d.source], size[d.doc_id])
    targets = brute.targets(dict(total))
    source = {d.doc_id: d.source for d in documents}
    for r in QUERIES["op4_mixing"](spark, sf_dir).collect():
        own = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], total[own])
        assert r.target == pytest.approx(targets[own]) and 0 <= r.taken <= 3 * r["size"]
        taken[own] += r.taken
    for name, target in targets.items():
        assert abs(taken[name] - target) <= max(0.05 * target, largest[name] / 2)


def test_op8_counts(spark, sf_dir, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in QUERIES["op8_token_counts"](spark, sf_dir).collect()}
    assert len(found) == len(documents)
    for d in documents:
        n = len(tokenizer.encode(d.text or "", add_special_tokens=False).ids)
        r = found[d.doc_id]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((d.text or "").encode()), n > 1024)


def test_op9_scores_every_document(spark, sf_dir, documents):
    rows = QUERIES["op9_toxicity"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in documents)
    assert all(0 <= p <= 1 for r in rows for p in (r.p_low_quality, r.p_toxic))
    assert all(r.toxic == (r.p_toxic >= 0.5) for r in rows)


def test_op9_on_labels_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    unseen = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    chain = toxicity.learn(docs, labels.where(~unseen), ("low_quality", "toxic"))
    scored = toxicity.toxicity(docs, chain).select("row.doc_id", F.col("probabilities")[1].alias("p"))
    rows = scored.join(labels.where(unseen), "doc_id").collect()
    found = [r.toxic == 1 for r in rows if r.p >= 0.5]
    assert sum(found) / len(found) >= 0.9
    assert sum(found) / sum(r.toxic == 1 for r in rows) >= 0.7
