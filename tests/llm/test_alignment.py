from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import brute
from precinct.llm import alignment, perfect_hash
from precinct.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b", " \n x", "don't", "it's  ", "日本 語", "é́ ", "<|endoftext|>", "</s>", "12 34", " ", "…  …",
    "　a b", "word", "the", " ", "x", "\x00", "🙂 🙂", "\t\t", "<0x41>",
]


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B)


def a_bytes(token):
    """A's tokens decoded by the library itself, one by one, cannot give partial characters."""
    table = {}
    shift = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            table[chr(byte)] = byte
        else:
            table[chr(256 + shift)] = byte
            shift += 1
    return bytes(table[c] for c in token)


def b_bytes(piece):
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def plain(text, libraries):
    """Groups and links of one text, by comparing every two byte ranges."""
    one, other = libraries
    if not text:
        return None
    a = one.encode(" " + text, add_special_tokens=False)
    b = other.encode(text)
    a_parts = [a_bytes(t) for t in a.tokens]
    b_parts = [b_bytes(other.id_to_piece(k)) for k in b]
    data = (" " + text).encode()
    if b"".join(a_parts) != data or b"".join(b_parts) != data:
        return None

    def ranges(parts):
        ends = np.cumsum([len(p) for p in parts])
        return list(zip((ends - [len(p) for p in parts]).tolist(), ends.tolist()))

    ra, rb = ranges(a_parts), ranges(b_parts)
    common = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, start = [], 0
    for end in common:
        ids = [",".join(str(k) for k, (s, e) in zip(own, spans) if s >= start and e <= end) for own, spans in ((a.ids, ra), (b, rb))]
        groups.append("|".join(ids))
        start = end
    links = [(a.ids[i], b[j]) for i, (s, e) in enumerate(ra) for j, (t, f) in enumerate(rb) if max(s, t) < min(e, f)]
    return len(ra), len(rb), ";".join(groups), len(common), links


def expected(texts, libraries):
    found = [plain(t, libraries) for t in texts]
    held = Counter(link for one in found if one for link in set(one[4]))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    rows = []
    for one in found:
        if one is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, n_groups, links = one
        n_best = sum(held[link] == best[link[0]] for link in links)
        rows.append((n_a, n_b, n_groups, len(links), n_best, sum(held[link] for link in links), groups))
    return rows, held


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(3)
    for size in (0, 1, 2, 100, 20_000):
        keys = np.unique(rng.integers(0, 1 << 62, size))
        sizes, bits = perfect_hash.build(keys)
        hashed = perfect_hash.PerfectHash(sizes, bits)
        assert sorted(hashed.numbers(keys)) == list(range(len(keys)))
        strangers = hashed.numbers(rng.integers(-(1 << 62), 0, 50))
        assert (strangers < max(1, len(keys))).all()
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([7, 7]))


def test_pieces_add_up_to_the_whole_text(libraries):
    rng = random.Random(11)
    own = alignment.aligner(A, B)
    assert own.cuts
    for _ in range(400):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(1, 20)))
        found, whole = own.align(own.pieces(text)), plain(text, libraries)
        assert found.valid.all() == (whole is not None)
        if whole is not None:
            assert ";".join(found.groups) == whole[2]
            assert (found.n_a.sum(), found.n_b.sum(), found.n_groups.sum()) == (whole[0], whole[1], whole[3])
            assert sorted(found.keys) == sorted(a << alignment.BITS | b for a, b in whole[4])
    # One invalid piece leaves the others as they are.
    mixed = own.align([" one", " a▁b", " two words", "  "])
    assert mixed.valid.tolist() == [True, False, True, True]
    assert mixed.n_a[1] == mixed.n_links[1] == 0 and mixed.groups[1] == ""
    assert mixed.groups[2] == own.align([" two words"]).groups[0]


@pytest.mark.parametrize("options", [{}, {"shard_keys": 800, "block_keys": 2000, "fan": 2}])
def test_documents_against_every_two_ranges(spark, sf_dir, libraries, options):
    """With tiny shards and blocks there are many of both, a deep tree, and several second passes."""
    rng = random.Random(12)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500").limit(40).collect()]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts += [None, "", "same words here", "same words here", "▁", "a ▁ b"]
    rows, held = expected(texts, libraries)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    found = {r.row.doc_id: tuple(r[f] for f in FIELDS) for r in alignment.align(docs, A, B, **options).collect()}
    assert [found[k] for k in range(len(texts))] == rows
    counts = alignment.count_pairs(docs, A, B, **{k: v for k, v in options.items() if k != "block_keys"})
    assert {(r.a, r.b): r.n_documents for r in counts.table().collect()} == held


def test_counts_are_written_out_in_chunks(spark, monkeypatch):
    """What a task counts in several goes adds up."""
    docs = spark.createDataFrame([(k, f"word {k % 5} and more") for k in range(30)], "doc_id bigint, text string")
    usual = alignment.count_pairs(docs.coalesce(1), A, B).table().collect()
    monkeypatch.setattr(alignment, "TASK_PAIRS", 0)
    monkeypatch.setattr(alignment, "TEXTS", 4)
    batches = iter(docs.coalesce(1).select("text").toArrow().combine_chunks().to_batches())

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    monkeypatch.setattr(alignment, "TaskContext", Context)
    totals, chunks = Counter(), set()
    for batch in alignment._pair_counter(A, B)(batches):
        for chunk, pair, n in zip(*(batch[c].to_pylist() for c in ("chunk", "pair", "n"))):
            totals[pair >> alignment.BITS, pair & ((1 << alignment.BITS) - 1)] += n
            chunks.add(chunk)
    assert len(chunks) > 3
    assert totals == {(r.a, r.b): r.n_documents for r in usual}


def test_trouble(spark, trouble, nothing, libraries):
    found = alignment.align(trouble, A, B, keep=trouble.columns).collect()
    assert len(found) == len(brute.TROUBLE)
    by_text = {r.row.text: r for r in found}
    assert by_text[None].n_a == by_text[""].n_links == 0 and by_text[None].groups == ""
    assert by_text["mot " * 30_000].n_a >= 30_000
    one, other = libraries
    assert by_text["... !!! ???"].n_b == len(other.encode("... !!! ???"))
    assert alignment.align(nothing, A, B).count() == 0


def test_query_on_the_test_tables(spark, sf_dir, libraries):
    """The registered query, digest included, on every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    frame = QUERIES["op11_token_alignment"](spark, sf_dir)
    found = {r.doc_id: r for r in frame.collect()}
    assert set(found) == {d.doc_id for d in docs}
    short = [d for d in docs if len(d.text or "") < 1500]
    own = alignment.aligner(A, B)
    whole = {d.doc_id: own.align([" " + d.text] if d.text else []) for d in docs}
    held = Counter(k for one in whole.values() for k in set(one.keys.tolist()))
    for d in docs:
        one, row = whole[d.doc_id], found[d.doc_id]
        assert (row.n_a, row.n_b, row.n_links) == (one.n_a.sum(), one.n_b.sum(), len(one.keys))
        assert row.count_sum == sum(held[k] for k in one.keys.tolist())
        groups = ";".join(one.groups)
        assert row.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
    for d in short[:30]:
        assert plain(d.text, libraries)[2] == whole[d.doc_id].groups[0]
