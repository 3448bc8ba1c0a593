"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. Every text becomes its set of 5-word n-grams, a digest of that set and one hash per band.
   Texts with the same set are one node from here on.
2. Nodes sharing a band hash are candidates. Each bucket only links its members to its
   smallest node; the components of these links hold all pairs that share any band.
3. A component's sets meet in one task, which compares them. A component too large for that
   is compared bucket by bucket, and a bucket too large block by block, each pair in the
   first band its nodes share. No candidate is left out for size, and no pair is ever a row:
   tasks return links per node and the links that hold a class together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from precinct.llm.components import connected
from precinct.llm.tables import WORD_BYTES, column, map_texts, staged, text_of

N = 5
THRESHOLD = 0.8
ROWS = 6
RECALL = 0.999
# Nodes, and n-grams of their sets, that meet in one task.
BLOCK_NODES = 256
BLOCK_GRAMS = 2_000_000

_words = re.compile(WORD_BYTES)
_SIGNED = "digest binary, n_grams bigint, bands array<bigint>"


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` hashes so that a pair at the threshold shares one with ``recall``."""
    return ceil(log(1 - recall) / log(1 - threshold**rows))


def grams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; fewer words, but not none, are one n-gram."""
    words = _words.findall((text or "").encode().lower())
    if not words:
        return np.empty(0, np.uint64)
    found = {
        xxhash.xxh3_64_intdigest(b" ".join(words[i : i + n]))
        for i in range(max(1, len(words) - n + 1))
    }
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(20240229).integers(0, 1 << 63, (2, count), dtype=np.uint64)
    return draws[0] * np.uint64(2) + np.uint64(1), draws[1]


def band_hashes(gram_hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray, rows: int) -> list[int]:
    """MinHash signature, hashed per band; a few hundred n-grams at a time bound the memory."""
    lowest = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(gram_hashes), 512):
        part = gram_hashes[start : start + 512, None] * factors
        part += offsets
        np.minimum(lowest, part.min(axis=0), out=lowest)
    signature = lowest.tobytes()
    width = 8 * rows
    return [
        xxhash.xxh3_64_intdigest(signature[k : k + width], seed=k) - (1 << 63)
        for k in range(0, len(signature), width)
    ]


def _signer(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, offsets = _coefficients(bands * rows)
        for batch in batches:
            digests, counts, hashes = [], [], []
            for value in batch["text"]:
                own = grams(value.as_py(), n)
                counts.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                hashes.append(band_hashes(own, factors, offsets, rows) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"],
                    pa.array(digests, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(hashes, pa.list_(pa.int64())),
                    batch["key"],
                ],
                names=["row", "digest", "n_grams", "bands", "key"],
            )

    return run


def _gram_reader(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            sets, right = [], []
            for value, digest in zip(batch["text"], batch["digest"].to_pylist()):
                # Rows repeated with id and text all carry the digest; a task reads one of them.
                own = grams(None if digest in done else value.as_py(), n)
                right.append(xxhash.xxh3_128_digest(own.tobytes()) == digest)
                if right[-1]:
                    done.add(digest)
                sets.append(own.view(np.int64))
            row = batch.drop_columns(["text"])
            made = row.append_column("grams", pa.array(sets, pa.list_(pa.int64())))
            # Another text under the same document id does not stand for this digest.
            yield made.filter(pa.array(right))

    return run


def shared_counts(sets: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
    """How many n-grams each two sets share, through products of 0/1 matrices."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, index, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[index] > 1
    owner, index = owner[common], index[common]
    order = np.argsort(index, kind="stable")
    owner, index = owner[order], index[order]
    # Ranks of the n-grams that two sets or more have.
    rank = np.cumsum(np.r_[False, index[1:] != index[:-1]]) if len(index) else index
    total = np.zeros((n, n), np.float64)
    for start in range(0, int(rank[-1]) + 1 if len(rank) else 0, chunk):
        a, b = np.searchsorted(rank, [start, start + chunk])
        dense = np.zeros((n, chunk), np.float32)
        dense[owner[a:b], rank[a:b] - start] = 1
        total += dense @ dense.T
    return total


def _verifier(threshold: float):
    """Compare the sets of one block, or of two blocks across."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band, one, two = key[1].as_py(), key[2].as_py(), key[3].as_py()
        first = {}
        for k, digest in enumerate(table["digest"].to_pylist()):
            first.setdefault(digest, k)  # a document may stand in the table twice
        table = table.take(pa.array(sorted(first.values())))
        digests = table["digest"].to_pylist()
        weights = np.array(table["copies"].to_pylist(), np.int64)
        sizes = np.array(table["n_grams"].to_pylist(), np.float64)
        lists = table["grams"].combine_chunks()
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        shared = shared_counts([flat[a:b] for a, b in zip(ends[:-1], ends[1:])])
        linked = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
        np.fill_diagonal(linked, False)
        block = np.array(table["block"].to_pylist())
        if one != two:
            linked &= block[:, None] != block[None, :]
        if band >= 0:
            bands = np.array(table["bands"].to_pylist(), np.int64)
            for earlier in range(band):
                linked &= bands[:, None, earlier] != bands[None, :, earlier]
            linked &= bands[:, None, band] == bands[None, :, band]
        links = linked @ weights
        roots = list(range(len(digests)))
        for start in sorted(range(len(digests)), key=digests.__getitem__):
            if roots[start] != start:
                continue
            reached, front = {start}, [start]
            while front:
                for k in np.flatnonzero(linked[front.pop()]):
                    if k not in reached:
                        reached.add(int(k))
                        front.append(int(k))
            for k in reached:
                roots[k] = start
        keep = np.flatnonzero(links > 0)
        return pa.table(
            {
                "digest": pa.array([digests[k] for k in keep], pa.binary()),
                "links": pa.array(links[keep], pa.int64()),
                "root": pa.array([digests[roots[k]] for k in keep], pa.binary()),
            }
        )

    return run


def document_key(docs: DataFrame) -> Column:
    """Tells documents apart: equal keys only for the same id and text."""
    return F.concat_ws(
        ":", F.coalesce(column("doc_id").cast("string"), F.lit("null")), F.xxhash64(text_of(docs))
    )


def _units(nodes: DataFrame, buckets: DataFrame, block_nodes: int, block_grams: int) -> DataFrame:
    """Which comparisons each node takes part in: (digest, jobs array of unit, band, blocks)."""
    members = staged(buckets, "members")
    grouped = connected(members.select("digest", "first"), "digest", "first", "candidates")
    grouped = staged(
        grouped.withColumnRenamed("node", "digest").join(nodes.select("digest", "n_grams"), "digest"),
        "candidate-nodes",
    )
    fits = (F.col("nodes") <= block_nodes) & (F.col("grams") <= block_grams)
    sized = staged(
        grouped.groupBy("root")
        .agg(F.count(F.lit(1)).alias("nodes"), F.sum("n_grams").alias("grams"))
        .withColumn("whole", fits)
        .select("root", "whole"),
        "component-sizes",
    )
    placed = grouped.join(sized, "root")
    zero = F.lit(0)
    whole = placed.where("whole").select(
        "digest",
        F.struct(
            F.col("root").alias("unit"), F.lit(-1).alias("band"), zero.alias("one"),
            zero.alias("two"), zero.alias("block"),
        ).alias("job"),
    )
    parts = members.join(placed.where(~F.col("whole")).select("digest", "n_grams"), "digest")
    blocks = F.ceil(
        F.greatest(F.count(F.lit(1)) / F.lit(block_nodes), F.sum("n_grams") / F.lit(block_grams))
    ).cast("int")
    parts = staged(parts, "parts")
    counted = staged(parts.groupBy("band", "bucket").agg(blocks.alias("blocks")), "blocks")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    cut = (
        parts.join(counted, ["band", "bucket"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        .select(
            "digest",
            F.struct(
                F.col("bucket").cast("string").cast("binary").alias("unit"), "band",
                F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                "block",
            ).alias("job"),
        )
    )
    return whole.unionByName(cut).groupBy("digest").agg(F.collect_list("job").alias("jobs"))


def near_duplicates(
    docs: DataFrame,
    *,
    keep: Sequence[str] = ("doc_id",),
    n: int = N,
    threshold: float = THRESHOLD,
    rows: int = ROWS,
    recall: float = RECALL,
    block_nodes: int = BLOCK_NODES,
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """Classes and links of documents whose n-gram sets have a Jaccard similarity of at
    least ``threshold``.

    Returns one row per document: ``row`` (the columns in ``keep``, ``doc_id`` among them), ``n_grams``, ``copy_id``
    (smallest doc_id with the same n-grams), ``class_id`` (smallest doc_id among all that
    links connect), ``n_links`` (other documents it is similar to, exact copies included) and
    ``class_key`` (``document_key`` of one document of the class, by smallest doc_id).

    ``recall`` is the least chance of finding a pair at the threshold; pairs above it have a
    better one. Every pair reported is verified on its full sets.

    Memory per task is bounded by ``block_nodes`` and ``block_grams``, of which one or two
    blocks meet, whatever the size of a group of copies. A text longer than that is a block
    of its own. Rows repeated with id and text count as copies, and at most one of them per task
    reaches a comparison.

    A null or empty text, or one without words, has no n-grams, links to nothing and is its
    own class. Repeated rows are copies of each other. Null ids are allowed; a class all of
    whose ids are null has a null ``class_id``. An empty table gives no rows.
    """
    bands = bands_for(threshold, rows, recall)
    key = document_key(docs).alias("key")
    signed = staged(
        map_texts(docs, keep, _signer(n, bands, rows), f"{_SIGNED}, key string", key)
        .withColumn("doc_id", F.col("row")["doc_id"]),
        "signed",
    )
    nodes = staged(
        signed.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("chosen"),
            F.first("n_grams").alias("n_grams"),
            F.first("bands").alias("bands"),
        ),
        "nodes",
    )
    placed = nodes.select("digest", F.posexplode("bands").alias("band", "bucket"))
    shared = staged(
        placed.groupBy("band", "bucket")
        .agg(F.count(F.lit(1)).alias("nodes"), F.min("digest").alias("first"))
        .where("nodes > 1")
        .select("band", "bucket", "first"),
        "shared-buckets",
    )
    buckets = placed.join(shared, ["band", "bucket"])
    jobs = (
        _units(nodes, buckets, block_nodes, block_grams)
        .join(nodes.select("digest", "copies", "n_grams", "bands", F.col("chosen.key").alias("key")), "digest")
    )
    jobs = staged(jobs, "jobs")
    texts = docs.select(key, text_of(docs).alias("text")).join(jobs, "key")
    ordered = texts.select("text", *jobs.columns)
    read = ordered.mapInArrow(
        _gram_reader(n),
        ordered.drop("text").schema.add("grams", ArrayType(LongType())),
    )
    compared = (
        read.withColumn("job", F.explode("jobs"))
        .select("digest", "copies", "n_grams", "bands", "grams", "job.*")
        .groupBy("unit", "band", "one", "two")
        .applyInArrow(_verifier(threshold), "digest binary, links bigint, root binary")
    )
    compared = staged(compared, "compared")
    classes = connected(compared, "digest", "root", "classes").withColumnRenamed("node", "digest")
    links = compared.groupBy("digest").agg(F.sum("links").alias("links"))
    merged = staged(
        nodes.select("digest", "copies", "chosen")
        .join(links, "digest", "left")
        .join(classes, "digest", "left")
        .where("copies > 1 OR links > 0")
        .withColumn("root", F.coalesce("root", "digest")),
        "merged",
    )
    heads = staged(merged.groupBy("root").agg(F.min("chosen").alias("head")), "heads")
    found = staged(
        merged.join(heads, "root").select(
            "digest",
            F.col("chosen.doc_id").alias("copy_id"),
            F.col("head.doc_id").alias("class_id"),
            F.col("head.key").alias("class_key"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "found",
    )
    alone = F.col("n_links").isNull()
    return signed.join(found, "digest", "left").select(
        "row",
        "n_grams",
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_key", "key").alias("class_key"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id.

    Documents without words stay, one of each id and text.
    """
    key = document_key(docs)
    heads = near_duplicates(docs, **options).select(F.col("class_key").alias("key")).distinct()
    name = "key"
    while name in docs.columns:
        name += "_"
    return (
        docs.withColumn(name, key)
        .join(heads.withColumnRenamed("key", name), name, "left_semi")
        .dropDuplicates([name])
        .select(*[column(c) for c in docs.columns])
    )
