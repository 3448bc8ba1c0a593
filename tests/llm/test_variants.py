from __future__ import annotations

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from precinct.llm import queries, variants


def apart(one, other):
    """Every single edit, written out."""
    if len(one) > len(other):
        one, other = other, one
    if len(one) == len(other):
        return sum(a != b for a, b in zip(one, other)) == 1
    return any(other[:k] + other[k + 1 :] == one for k in range(len(other)))


def plain(words, ratio=5):
    forms, rows = {}, {}
    for word, n in words.items():
        near = [w for w in words if apart(word, w)]
        best = min(near, key=lambda w: (-words[w], w), default=None)
        forms[word] = best if best is not None and words[best] >= ratio * n else None
        rows[word] = [n, len(near)]
    for word in words:
        root = word
        while forms[root] is not None:
            root = forms[root]
        rows[word] += [forms[word], words.get(forms[word]) if forms[word] is not None else None, root]
    return {word: tuple(row) for word, row in rows.items()}


def found(spark, words, **options):
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    return {
        r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.group_variants(table, **options).collect()
    }


def some_words(seed, count, letters="abcdéÿ", most=9):
    rng = random.Random(seed)
    words = {}
    while len(words) < count:
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, most)))
        words[word] = rng.choice([1, 2, 5, 10, 25, 26, 130, 700])
    return words


@settings(max_examples=300, deadline=None)
@given(st.text("abcé", max_size=6), st.text("abcé", max_size=6))
def test_one_apart(one, other):
    assert variants.one_apart(one, other) == (one != other and apart(one, other))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcdé", min_size=1, max_size=6), min_size=1, max_size=60, unique=True), st.permutations(range(5)))
def test_search_in_the_trie_reaches_all_near_words(words, order):
    root = variants.trie([(variants.vector(w, order), w, 1) for w in words], 0)
    for word in words:
        leaves = list(variants.reached(root, variants.vector(word, order), 0, 1, 1))
        candidates = [w for leaf in leaves for w, _ in leaf]
        assert len(candidates) == len(set(candidates))
        near = {w for w in words if apart(word, w)}
        assert near <= set(candidates)
        head, tail = variants.half(word)
        assert all(w.startswith(head) or w.endswith(tail) for w in near)


@pytest.mark.parametrize(
    "options",
    [{}, {"node_words": 20}, {"groups": 2, "node_words": 3, "node_searches": 5}, {"groups": 1, "node_words": 40}],
)
def test_groups_against_every_two_words(spark, options):
    """Few words per node make the routing deep; few groups make nodes that must be cut."""
    words = some_words(1, 500)
    assert found(spark, words, **options) == plain(words)


def test_vectors_are_the_same_in_sql(spark):
    words = ["", "a", "abcabc", "éÿÀ", "zzz"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    rows = table.select("word", variants.vector_column(table["word"]).alias("v")).collect()
    assert {r.word: tuple(r.v) for r in rows} == {w: variants.vector(w, range(variants.GROUPS)) for w in words}


def test_chains_ties_and_hot_roots(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15_625}
    words |= {"aaaaac": 25, "bbbbbb": 3125}
    rows = found(spark, words)
    assert rows["aaaaaa"] == (5, 2, "aaaaab", 25, "abbbbb")
    assert rows == plain(words)
    hot = {"mmmmmmmm": 10**9} | {"mmmmmmmm"[:k] + c + "mmmmmmmm"[k + 1 :]: 3 for k in range(8) for c in "abcdefghij"}
    rows = found(spark, hot, node_words=10)
    assert rows == plain(hot) and sum(r[4] == "mmmmmmmm" for r in rows.values()) == len(hot)


def test_trouble(spark):
    nothing = spark.createDataFrame([], "word string, n bigint")
    assert variants.group_variants(nothing).count() == 0
    odd = spark.createDataFrame([("", 1, "x"), ("a", 9, "x"), (None, 7, "x"), ("x" * 3000, 2, "x"), ("x" * 2999, 99, "x")], "word string, n bigint, node string")
    rows = {r.word: (r.form, r.root, r.n_near) for r in variants.group_variants(odd).collect()}
    assert rows == {
        "": ("a", "a", 1), "a": (None, "a", 1),
        "x" * 3000: ("x" * 2999, "x" * 2999, 1), "x" * 2999: (None, "x" * 2999, 1),
    }
    with pytest.raises(ValueError):
        variants.group_variants(odd, ratio=1)


def test_misspelt_words(spark, trouble, nothing):
    rng = random.Random(4)
    stock = ["Straße", "éclair", "letters", "MIXED", "Àé", "ordinary", "seventh", "tiny"]
    docs = [(k if k % 9 else None, ", ".join(rng.choices(stock, k=400))) for k in range(120)]
    counts = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for k, text in docs:
        for run in text.translate(lower).split(", "):
            check = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if check % 199 == 0:
                run = run[: check % len(run)] + run[check % len(run) + 1 :]
            counts[run] += 1
    rows = queries.misspelt_words(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.word: r.n for r in rows} == {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert len(rows) > len([w for w in stock if len(w) >= 6])
    assert queries.misspelt_words(nothing).count() == 0
    assert {r.word for r in queries.misspelt_words(trouble).collect()} <= {w for t in brute.TROUBLE for w in brute.words(t[1])}


def test_plan_has_no_cross_join(spark, sf_dir):
    plan = queries.QUERIES["op13_spelling_variants"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
