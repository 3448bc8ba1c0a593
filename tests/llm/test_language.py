from __future__ import annotations

import random

import numpy as np
import pytest

import brute
from precinct.llm import language
from precinct.llm.queries import op6_language_id

SYLLABLES = {"xx": ["ba", "ne", "zu", "ko"], "yy": ["schl", "üng", "ätz", "ierk"], "zz": ["oque", "ción", "ñal", "ueg"]}


def text_in(rng, name, n):
    return " ".join("".join(rng.choice(SYLLABLES[name]) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows = [(k, text_in(rng, name := rng.choice(list(SYLLABLES)), 60), name) for k in range(240)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").cache()


@pytest.fixture(scope="module")
def net(labelled):
    return language.learn(labelled.where("doc_id % 2 = 0"))


def test_unseen_texts_are_told_apart(labelled, net):
    rows = language.identify(labelled.where("doc_id % 2 = 1"), net, keep=("lang",)).collect()
    assert np.mean([r.row.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_whole_texts_count(net):
    rng = random.Random(3)
    start = text_in(rng, "xx", 60)
    long = start + text_in(rng, "yy", 3_000)
    assert language.predict(net, [start, long]) != []
    assert [name for name, _ in language.predict(net, [start, long])] == ["xx", "yy"]


def test_batches_do_not_change_answers(net):
    rng = random.Random(4)
    texts = [text_in(rng, rng.choice(list(SYLLABLES)), rng.choice([1, 30, 900])) for _ in range(20)]
    together = language.predict(net, texts, at_once=3)
    for text, (name, score) in zip(texts, together):
        alone = language.predict(net, [text])[0]
        assert alone[0] == name and alone[1] == pytest.approx(score, abs=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    windows = rng.integers(1, 255, (4, 32)).astype(np.uint8)
    truth = np.array([0, 1, 1, 0])
    net = language.train(windows, truth, ["a", "b"], epochs=1)
    for name in ("embedding", "filters", "bias", "weights", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    weight = np.ones(4)

    def loss():
        chances = net.probabilities(windows)
        return -np.log(chances[np.arange(4), truth]).mean()

    grads = language._gradients(net, windows, truth, weight)
    for name in ("embedding", "filters", "bias", "weights", "offset"):
        values = getattr(net, name).reshape(-1)
        places = np.argsort(-np.abs(grads[name].reshape(-1)))[:5]
        for k in places:
            kept = values[k]
            values[k] = kept + 1e-6
            up = loss()
            values[k] = kept - 1e-6
            down = loss()
            values[k] = kept
            assert grads[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7)


def test_cut_covers_every_byte():
    for size in (0, 1, 255, 256, 257, 1000):
        data = bytes(range(1, 251)) * 4
        windows = language.cut(data[:size])
        assert windows.tobytes().rstrip(b"\0") == data[:size]
        assert len(windows) == max(1, -(-size // language.LENGTH))


def test_no_language_is_left_out(spark):
    rows = [(k, f"text number {k}", f"l{k % 201}") for k in range(402)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="more than 200 languages"):
        language.learn(docs)
    assert len(language.learn(docs, max_languages=201).languages) == 201
    assert len(language.learn(docs.where("lang <> 'l0'")).languages) == 200


def test_trouble(trouble, nothing, net):
    rows = language.identify(trouble, net, keep=trouble.columns).collect()
    assert len(rows) == len(brute.TROUBLE)
    for r in rows:
        unknown = not any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred == language.UNKNOWN) == unknown
    assert language.identify(nothing, net).count() == 0
    assert language.learn(nothing) is None
    assert {r.lang_pred for r in language.identify(trouble, None).collect()} == {language.UNKNOWN}


def test_held_out_documents_of_the_test_tables(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op6_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 20 and np.mean(held) > 0.9
