from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from precinct.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string"
NASTY = [
    "</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>hi<|im_end|>", "<\\|im_end|>", "<\\\\/s> \\", "<<SYS>>a<</SYS>>",
    "<", "<<", "[", "[[INST]", "a\n\n", "", "ü<s>", "<|im_end|", "$1\\2",
]


def conversations(seed: int):
    rng = random.Random(seed)
    rows = []
    for conv in range(25):
        count = rng.randrange(1, 60)
        for turn in range(count):
            role = "system" if turn == 0 and rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            text = " ".join(rng.choice([*NASTY, "word", "more words here"]) for _ in range(rng.randrange(0, 40)))
            rows.append((conv, turn, role, text))
    rows += [(100, t, ("user", "assistant")[t % 2], "long " * 900) for t in range(4)]
    rows += [(101, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(1_500)]
    return rows


def expected(rows):
    grouped: dict = {}
    for conv, turn, role, text in rows:
        grouped.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    result = {}
    for conv, turns in grouped.items():
        turns.sort()
        lines = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        result[conv] = (len(turns), brute.sha(lines), len(loss), brute.sha(loss))
    return result


@pytest.mark.parametrize("budget", [(512, 64), (64, 16)])
def test_round_trip_through_the_windows(spark, budget):
    rows = conversations(1)
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget=budget[0], history=budget[1])
    found = {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
        for r in chat.conversation_digests(windows).collect()
    }
    assert found == expected(rows)


def test_windows_keep_to_the_budget(spark):
    rows = conversations(2)
    frame = spark.createDataFrame(rows, TURNS)
    windows = chat.read_windows(chat.format_windows(frame)).collect()
    size = lambda text: len(brute.SPACE.findall(text)) + 1
    systems = {c: x for c, t, role, x in rows if t == 0 and role == "system"}
    several = 0
    for w in windows:
        own = sum(size(t["text"]) for t in w.turns if t["role"] != "system")
        system = size(systems[w.conv_id]) if w.conv_id in systems else 0
        capacity = max(chat.BUDGET - chat.HISTORY - system, chat.BUDGET // 4)
        assert own <= capacity or len(w.turns) == 1
        if w.window > 0:
            several += 1
            first = "<|im_start|>system<|im_sep|>"
            assert w.formatted.startswith(first) == (w.conv_id in systems)
    assert several > 10


def test_repeats_are_the_turns_before_and_never_targets(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t} " + "x " * 40) for t in range(40)]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget=256, history=64)
    for w in sorted(windows.collect(), key=lambda w: w.window)[1:]:
        head = w.formatted.split(chat.END)[: w.repeated]
        assert w.repeated == 1 and len(head) == 1
        end = sum(len(part) + len(chat.END) for part in head)
        assert all(span["start"] > end for span in w.loss)


@pytest.mark.parametrize("text", NASTY)
def test_escape_is_reversible_and_leaves_no_control_string(spark, text):
    frame = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"))
    row = frame.select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert row.u == text
    for mark in (chat.START, chat.SEPARATOR, chat.END, "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        assert mark not in row.e


def test_trouble(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"),
        (None, 1, "assistant", "c"), (None, 0, "user", None), (2, 0, "system", "only"),
        (3, 0, "sys\ntem<|im_sep|>", "x"), (4, 0, "assistant", "wörd " * 50_000),
    ]
    frame = spark.createDataFrame(rows, TURNS).withColumn("window", F.lit("mine")).withColumn("conv", F.lit(1))
    found = chat.conversation_digests(chat.format_windows(frame)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == expected(rows)
    assert chat.format_windows(spark.createDataFrame([], TURNS)).count() == 0


def long_systems(seed: int):
    rng = random.Random(seed)
    rows = []
    for conv, size in enumerate([*range(0, 600, 40), 319, 320, 321, 383, 384, 385, 447, 511, 512, 600]):
        rows.append((conv, 0, "system", "s " * size))
        for turn in range(1, 40):
            length = rng.choice([5, 30, 100, 200, 511, 512, 700]) if turn % 7 == 0 else rng.randrange(60)
            rows.append((conv, turn, ("user", "assistant")[turn % 2], f"w{turn} " * length))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_no_window_exceeds_the_budget_whatever_the_system_turn(spark, seed):
    rows = long_systems(seed)
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS)).collect()
    size = {conv: len(text.split()) + 1 for conv, turn, _, text in rows if turn == 0}
    retained = 0
    for w in windows:
        texts = [part.split(chat.SEPARATOR)[1] for part in w.formatted.split(chat.END)[:-1]]
        tokens = [len(brute.SPACE.findall(text)) + 1 for text in texts]
        assert sum(tokens) <= chat.BUDGET or len(tokens) == 1
        system = w.formatted.startswith(f"{chat.START}system")
        if w.window > 0 and size[w.conv_id] <= 384 and sum(tokens) - size[w.conv_id] * system + size[w.conv_id] <= chat.BUDGET:
            assert system
            retained += 1
        if size[w.conv_id] > 384:
            assert system == (w.window < 0) and (not system or len(tokens) == 1)
    assert retained > 50
    found = {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
        for r in chat.conversation_digests(chat.format_windows(spark.createDataFrame(rows, TURNS))).collect()
    }
    assert found == expected(rows)
