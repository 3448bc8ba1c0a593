from __future__ import annotations

import random

import numpy as np
import pytest

import brute
from precinct.llm import toxicity

LABELS = "doc_id bigint, rude int, toxic int"


@pytest.fixture(scope="module")
def study(spark):
    """Rude texts hold one of three words; toxic ones are rude and hold one other."""
    rng = random.Random(9)
    docs, labels = [], []
    for k in range(700):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
        rude, extra = rng.random() < 0.4, rng.random() < 0.5
        if rude:
            words[rng.randrange(60)] = rng.choice(["grumpf", "zonk", "blergh"])
        if extra:
            words[rng.randrange(60)] = "qqone"
        docs.append((k, " ".join(words)))
        noisy = rng.random() < 0.03
        labels.append((k, int(rude != noisy), int((rude and extra) != noisy)))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    truth = {k: ("grumpf" in t or "zonk" in t or "blergh" in t, "qq" in t) for k, t in docs}
    return frame, spark.createDataFrame(labels, LABELS), truth


def test_unseen_documents(study):
    docs, labels, truth = study
    chain = toxicity.learn(docs, labels.where("doc_id % 3 > 0"), ("rude", "toxic"))
    assert [len(model.earlier) for model in chain] == [0, 1] and chain[1].earlier[0] > 0
    rows = toxicity.toxicity(docs.where("doc_id % 3 = 0"), chain).collect()
    rude = [(r.probabilities[0] >= 0.5) == truth[r.row.doc_id][0] for r in rows]
    toxic = [(r.probabilities[1] >= 0.5) == all(truth[r.row.doc_id]) for r in rows]
    assert np.mean(rude) > 0.97 and np.mean(toxic) > 0.9


def test_later_models_train_on_unseen_probabilities(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, 9)).astype(np.int32) for _ in range(60)]
    labels = np.column_stack([rng.integers(0, 2, 60), rng.integers(0, 2, 60)])
    folds = np.arange(60) % 3
    seen = []
    real = toxicity.fit_linear

    def spy(part, earlier, truth):
        seen.append((len(part), earlier.shape))
        return real(part, earlier, truth)

    monkeypatch.setattr(toxicity, "fit_linear", spy)
    toxicity.fit_chain(sets, labels, folds)
    assert seen == [(60, (60, 0)), (40, (40, 0)), (40, (40, 0)), (40, (40, 0)), (60, (60, 1))]


def test_near_copies_count_once():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 17, 200)).astype(np.int32)
    near = np.unique(np.r_[base[:-3], rng.integers(0, 1 << 17, 3)]).astype(np.int32)
    other = np.unique(rng.integers(0, 1 << 17, 200)).astype(np.int32)
    empty = np.empty(0, np.int32)
    assert toxicity.unlike([base, near, base, other, empty, empty]) == [0, 3, 4]


def test_unrelated_documents_all_stay():
    # Any two have a Jaccard similarity of about 0.1; bands of 3 minimum hashes alone drop hundreds.
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(500, 90, replace=False)).astype(np.int32) for _ in range(3000)]
    assert toxicity.unlike(sets) == list(range(3000))


def test_copies_with_other_labels_stay():
    one, other = np.arange(200, dtype=np.int32), np.arange(300, 500, dtype=np.int32)
    labels = [(0, 0), (0, 1), (0, 0), (0, 1), (0, 1)]
    assert toxicity.unlike([one, one, one, one, other], labels) == [0, 1, 4]


def test_the_chain_is_fitted_on_all_but_copies(spark, monkeypatch):
    # Few words, so that the texts have the same ones in another order.
    rng = random.Random(6)
    words = [f"word{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(300)]
    texts += [texts[0] + " end"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, int(k in (0, 304))) for k in range(305)], LABELS)
    fitted = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda sets, truth, folds: fitted.append(truth))
    toxicity.learn(docs, labels, ("rude", "toxic"))
    # Of document 0 and its copies 300 to 304 one of each of the labels (0, 1), (0, 0), (1, 0).
    assert len(fitted[0]) == 302 and fitted[0][:, 1].sum() == 1


def test_trouble(spark, trouble, nothing):
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (5, None, 1), (None, 1, 1), (7, 3, 0), (4, 1, 1)], LABELS)
    chain = toxicity.learn(trouble, labels, ("rude", "toxic"))
    rows = toxicity.toxicity(trouble, chain, keep=trouble.columns).collect()
    assert len(rows) == len(brute.TROUBLE)
    assert all(0 <= p <= 1 for r in rows for p in r.probabilities)
    assert toxicity.toxicity(nothing, chain).count() == 0
    assert toxicity.learn(nothing, labels, ("rude", "toxic")) == []
    assert {tuple(r.probabilities) for r in toxicity.toxicity(trouble, []).collect()} == {()}
