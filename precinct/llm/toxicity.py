"""Toxicity by a classifier chain over hashed words.

The categories have an order. The model of each is linear in the words of a text and in the
probabilities of the categories before it. In training those probabilities come from models
that have not seen the document, fold by fold, so that later models meet the same kind of
input as in use.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.llm.near_duplicates import grams
from precinct.llm.tables import column, map_texts, text_of

BUCKETS = 1 << 17
# The sample of labelled documents the chain is fitted on, and the folds of its training.
MAX_LABELLED = 8_000
# Beginnings of words, in bytes, that count as features of their own: insults are inflected.
PREFIXES = (4, 5, 6, 7)
FOLDS = 3
# Texts count as near copies from this Jaccard similarity of their 5-word n-grams on.
ALIKE = 0.8
# A word counts if chance explains how it is spread over the labels with odds of e^-EVIDENCE.
EVIDENCE = 12.0
STEPS = 250
PENALTY = 1e-4

_words = re.compile(rb"[^\x00-\x26\x28-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text: str | None) -> np.ndarray:
    """Buckets of the distinct words of a whole text and of their beginnings, A-Z in lower
    case; null has none."""
    words = set(_words.findall((text or "").encode().lower()))
    parts = words.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in PREFIXES))
    found = np.fromiter(map(zlib.crc32, parts), np.uint32, len(parts))
    return np.unique(found & np.uint32(BUCKETS - 1)).astype(np.int32)


@dataclass
class Linear:
    """Weights of words, of the earlier categories' probabilities, and an offset."""

    words: np.ndarray
    earlier: np.ndarray
    offset: float

    def probability(self, buckets: np.ndarray, earlier: Sequence[float]) -> float:
        score = self.words[buckets].sum() + np.dot(self.earlier, earlier) + self.offset
        return float(1 / (1 + np.exp(-np.clip(score, -30, 30))))


def unlike(
    sets: list[np.ndarray],
    labels: Sequence[tuple] | None = None,
    *,
    alike: float = ALIKE,
    bands: int = 8,
    rows: int = 3,
) -> list[int]:
    """One document of each group of near copies with the same labels.

    Copies of one text repeat its label, noise included, and would pass for evidence. A
    document goes only if a kept one with its labels has a Jaccard similarity of at least
    ``alike``, counted on the two sets; bands of minimum hashes only say whom to compare
    (99.7 % of pairs at 0.8 share one). ``sets`` are sorted and distinct.
    """
    factors = np.random.default_rng(11).integers(0, 1 << 62, bands * rows, dtype=np.uint64) * 2 + 1
    seen: dict[tuple, list[int]] = {}
    kept = []
    for k, own in enumerate(sets):
        label = tuple(labels[k]) if labels is not None else ()
        if len(own):
            lowest = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for start in range(0, len(own), 4096):
                part = own[start : start + 4096].astype(np.uint64)
                mixed = (part + np.uint64(1))[:, None] * factors
                np.minimum(lowest, (mixed ^ (mixed >> np.uint64(29))).min(axis=0), out=lowest)
            keys = [
                (label, band, *map(int, values)) for band, values in enumerate(lowest.reshape(bands, rows))
            ]
        else:
            keys = [(label,)]
        if any(_similar(own, sets[j], alike) for j in sorted({j for key in keys for j in seen.get(key, ())})):
            continue
        kept.append(k)
        for key in keys:
            seen.setdefault(key, []).append(k)
    return kept


def _similar(one: np.ndarray, two: np.ndarray, alike: float) -> bool:
    less, more = sorted((len(one), len(two)))
    if less < alike * more:
        return False
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return shared >= alike * (less + more - shared) - 1e-9


def telling(index: np.ndarray, owner: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Which buckets are spread over the labels in a way that chance does not explain.

    With n documents of a bucket, a share s of them positive and a base rate b, that is
    n * KL(s || b) of at least ``EVIDENCE``. It keeps a noisy label from teaching the model
    the rare words of its text.
    """
    total = np.bincount(index, minlength=BUCKETS)
    positive = np.bincount(index, weights=truth[owner], minlength=BUCKETS)
    base = np.clip(truth.mean(), 1e-9, 1 - 1e-9)
    share = positive / np.maximum(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        yes = np.where(share > 0, share * np.log(share / base), 0)
        no = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)
    return total * (yes + no) >= EVIDENCE


def fit_linear(sets: list[np.ndarray], earlier: np.ndarray, truth: np.ndarray) -> Linear:
    """Logistic regression by Adam over all documents at once, with a quadratic penalty.

    Words without evidence (``telling``) keep weight 0.
    """
    index = np.concatenate(sets) if sets else np.empty(0, np.int32)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    kept = telling(index, owner, truth)[index] if len(sets) else np.empty(0, bool)
    used, index = np.unique(index[kept], return_inverse=True)
    owner = owner[kept]
    n, width = len(sets), earlier.shape[1]
    start = np.log((truth.sum() + 1) / (n - truth.sum() + 1))
    value = np.r_[np.zeros(len(used) + width), start]
    mean, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, STEPS + 1):
        score = np.bincount(owner, weights=value[index], minlength=n).astype(float)
        score += earlier @ value[len(used) : len(used) + width] + value[-1]
        miss = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - truth) / n
        grad = np.r_[
            np.bincount(index, weights=miss[owner], minlength=len(used)), earlier.T @ miss, miss.sum()
        ]
        grad[:-1] += PENALTY * value[:-1]
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad**2 - square)
        change = mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        value -= 0.1 * (1 - step / (STEPS + 1)) * change
    words = np.zeros(BUCKETS, np.float32)
    words[used] = value[: len(used)]
    return Linear(words, value[len(used) : len(used) + width], float(value[-1]))


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """One model per column of ``labels`` (0 or 1), in order, for documents in given folds."""
    chain: list[Linear] = []
    earlier = np.zeros((len(sets), 0))
    for k in range(labels.shape[1]):
        truth = labels[:, k].astype(float)
        chain.append(fit_linear(sets, earlier, truth))
        if k + 1 == labels.shape[1]:
            break
        unseen = np.empty(len(sets))
        for fold in np.unique(folds):
            out = folds == fold
            inside = np.flatnonzero(~out) if (~out).any() else np.arange(len(sets))
            model = fit_linear([sets[i] for i in inside], earlier[inside], truth[inside])
            for i in np.flatnonzero(out):
                unseen[i] = model.probability(sets[i], earlier[i])
        earlier = np.column_stack([earlier, unseen])
    return chain


def _hasher():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, copies = [], []
            for value in batch["text"]:
                text = value.as_py()
                sets.append(features(text))
                copies.append(np.unique(grams(text).astype(np.uint32)).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["row"], *[pa.array(x, pa.list_(pa.int32())) for x in (sets, copies)]],
                names=["row", "buckets", "grams"],
            )

    return run


def learn(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    *,
    max_labelled: int = MAX_LABELLED,
) -> list[Linear]:
    """Fit the chain on ``labels`` (doc_id and a 0/1 column per category) and their texts.

    At most ``max_labelled`` labelled documents are used, those with the smallest hash of
    their id; labels with a null are left out. Rows repeated under a labelled id count up to twice
    that bound in all. The word buckets of those documents and the
    hashes of their n-grams are what the driver holds, not their texts. Of near copies with
    the same labels one is used (``unlike``). Without labels the chain is empty.
    """
    known = labels.select(
        column("doc_id").alias("doc_id"), *[column(c).cast("int").alias(c) for c in categories]
    ).dropna()
    for name in categories:
        known = known.where(F.col(name).isin(0, 1))
    hashed = F.xxhash64("doc_id", F.lit("toxicity"))
    sample = known.orderBy(hashed, "doc_id", *categories).limit(max_labelled)
    # The limit above bounds the rows that are broadcast.
    joined = docs.select(column("doc_id").alias("doc_id"), text_of(docs).alias("text")).join(
        F.broadcast(sample.withColumn("fold", F.pmod(hashed, F.lit(FOLDS)))), "doc_id"
    )
    found = (
        map_texts(joined, ("doc_id", "fold", *categories), _hasher(), "buckets array<int>, grams array<int>")
        .orderBy("row", "buckets", "grams")
        .limit(2 * max_labelled)
        .select("row.*", "buckets", "grams")
        .toArrow()
    )
    if not found.num_rows:
        return []

    def arrays(name: str) -> list[np.ndarray]:
        lists = found[name].combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    sets = arrays("buckets")
    truth = np.column_stack([found[c].to_numpy() for c in categories])
    chosen = unlike([copy.view(np.uint32) for copy in arrays("grams")], truth.tolist())
    folds = found["fold"].to_numpy()[chosen]
    return fit_chain([sets[k] for k in chosen], truth[chosen], folds)


def _scorer(chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = chain.value
        for batch in batches:
            scores = []
            for value in batch["text"]:
                buckets, found = features(value.as_py()), []
                for model in models:
                    found.append(model.probability(buckets, found))
                scores.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(scores, pa.list_(pa.float64()))],
                names=["row", "probabilities"],
            )

    return run


def toxicity(
    docs: DataFrame, chain: list[Linear], *, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``row`` (the columns in ``keep``) and ``probabilities``, one per category in order.

    Whole texts are scored where they lie; only the chain, half a megabyte per category, is
    broadcast. Null and empty texts are scored without words. Repeated rows score alike, an
    empty table gives no rows, and an empty chain gives empty arrays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    return map_texts(docs, keep, _scorer(shared), "probabilities array<double>")
