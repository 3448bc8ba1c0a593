from __future__ import annotations

import random
import subprocess
import sys

import pytest

import brute
from precinct.llm.decontaminate import _shards, build, contamination, is_contaminated, merge, scan

ITEMS = "item_id bigint, text string"


def random_case(seed: int):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(6)] + ["Äpfel", "x1"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 2, 5, 13, 14, 30]))) for k in range(12)]
    docs = [(k, text(rng.randrange(0, 60)).upper()) for k in range(40)]
    for k in range(10):
        docs.append((100 + k, f"{text(20)} {rng.choice(items)[1]} {text(9)}"))
    return docs, items


@pytest.mark.parametrize("limit", [200_000, 40])
@pytest.mark.parametrize("seed", range(2))
def test_hits_equal_all_windows(spark, seed, limit):
    docs, items = random_case(seed)
    found = contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, ITEMS),
        words_per_automaton=limit,
    )
    rows = sorted((r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect())
    assert rows == sorted(brute.contamination(docs, items))


def test_spans_lie_in_the_original(spark):
    passage = "Die Äpfel-Größe, eins ZWEI drei vier fünf sechs sieben acht neun zehn elf"
    docs = spark.createDataFrame([(1, f"Öde… {passage}! Ende")], "doc_id bigint, text string")
    row = contamination(docs, spark.createDataFrame([(9, passage)], ITEMS)).first()
    text = f"Öde… {passage}! Ende"
    assert [text[s["start"] : s["end"]] for s in row.spans] == [passage]


def test_rule_of_contamination(spark):
    item = " ".join(f"q{k}" for k in range(13))
    docs = [(1, item + " z" * 247), (2, item + " z" * 248), (3, "z")]
    found = contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], ITEMS)
    )
    rows = {r.doc_id: r.bad for r in found.select("row.doc_id", is_contaminated().alias("bad")).collect()}
    assert rows == {1: True, 2: False, 3: False}


def test_trouble(spark, trouble, nothing):
    items = [(None, "one two three"), (3, None), (4, ""), (5, "two three"), (5, "two three")]
    benchmark = spark.createDataFrame(items, ITEMS)
    rows = contamination(trouble, benchmark, keep=trouble.columns).collect()
    assert len(rows) == len(brute.TROUBLE)
    assert sorted((r.n_hit, tuple(r["items"])) for r in rows if r.row.doc_id in (1, 7)) == [(3, (5,))] * 3
    assert all(r.n_hit == 0 for r in rows if r.row.doc_id not in (1, 7))
    assert all(r.row["n_words"] == "mine" for r in rows)
    assert contamination(nothing, benchmark).count() == 0
    empty = spark.createDataFrame([], ITEMS)
    assert {r.n_hit for r in contamination(trouble, empty).collect()} == {0}


def test_merging_runs_and_an_empty_automaton():
    assert merge([(5, 8), (0, 2), (3, 4), (10, 11)]) == [(0, 8), (10, 11)]
    assert scan("a b", *build([])) == (2, [], set())


def test_ids_of_any_type(spark):
    passage = " ".join(f"q{k}" for k in range(20))
    items = [("b-2", passage), ("b-10", passage + " end"), (None, "one two"), ("b-1", "three four")]
    docs = [(1, f"x {passage} y"), (2, "one two three four"), (3, None)]
    found = contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id string, text string"),
    )
    rows = {r.row.doc_id: (r.n_hit, r["items"]) for r in found.collect()}
    assert rows == {1: (20, ["b-10", "b-2"]), 2: (4, ["b-1"]), 3: (0, [])}


def test_every_window_holds_a_block():
    rng = random.Random(3)
    for size in (1, 2, 5, 12, 13):
        item = [f"w{k}" for k in range(40)]
        made = build([(7, " ".join(item))], size)
        for start in range(40 - size + 1):
            text = ["x"] * rng.randrange(3) + item[start : start + size] + ["x"] * rng.randrange(3)
            n_words, runs, items = scan(" ".join(text), *made, size)
            first = text.index(item[start])
            assert (n_words, runs, items) == (len(text), [(first, first + size - 1)], {7})


def test_groups_keep_to_the_limit(spark):
    items = [(k, " ".join(f"v{k}x{i}" for i in range(20))) for k in range(300)]
    table = spark.createDataFrame(items, ITEMS)
    groups = list(_shards(table, 1_000))
    assert all(sum(len(text.split()) for _, text in group) <= 1_000 for group in groups)
    assert sorted(row for group in groups for row in group) == sorted(items) and len(groups) <= 12
    assert [sorted(group) for group in _shards(table, 6_000)] == [sorted(items)]


def test_a_million_words_are_one_automaton():
    """Built in a process of its own, whose memory is measured."""
    code = """
import random, resource
from precinct.llm.decontaminate import WORDS_PER_AUTOMATON, build, scan
rng = random.Random(1)
assert WORDS_PER_AUTOMATON >= 1_000_000
items = [(k, " ".join(f"w{rng.randrange(400_000)}" for _ in range(100))) for k in range(10_000)]
made = build(items)
words = items[5_000][1].split()
assert scan(" ".join(["x"] * 9 + words[31:44]), *made) == (22, [(9, 21)], {5_000})
assert scan(" ".join(words[31:43]), *made) == (12, [], set())
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(made.stdout) < 1_000
