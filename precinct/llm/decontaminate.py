"""Benchmark decontamination: one scan of every text through an Aho-Corasick automaton.

The automaton runs over words, not their letters. Every distinct benchmark word becomes a
code of three characters out of three private alphabets of 128, so that no node has more
children than that to search, and a document is scanned as the codes of its words. Words the
benchmark does not use share one code that no window holds. Matches start and end at words by
construction, and their word positions lead back to offsets in the original text.

Windows of one item overlap, and as patterns of their own they would need 13 nodes a word.
But every 13 words of an item hold one of the blocks of 7 that start at multiples of 7, so
the automaton knows the blocks, one node a word, and each match looks up the seven windows
around it. Items shorter than a window are patterns themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from precinct.llm.tables import WORD_BYTES, column, map_texts, staged, with_row

WINDOW = 13
# Words per automaton: one node, one window and one distinct word each at most.
WORDS_PER_AUTOMATON = 1_000_000
# Parts of a larger benchmark per automaton; whole parts are packed together.
PARTS = 64

_words = re.compile(WORD_BYTES)
_WIDTH, _BASE = 3, 128
_OTHER = "\0" * _WIDTH


class _Alphabet(dict):
    """Word to private code; words that were never added share one."""

    def __missing__(self, word: bytes) -> str:
        return _OTHER

    def add(self, word: bytes) -> str:
        if word not in self:
            high, low = divmod(len(self), _BASE)
            top, middle = divmod(high, _BASE)
            if top >= _BASE:
                raise ValueError(f"more than {_BASE**_WIDTH} distinct words in one automaton")
            self[word] = chr(1 + low) + chr(1 + _BASE + middle) + chr(1 + 2 * _BASE + top)
        return self[word]


def build(items: Sequence[tuple[object, str]], size: int = WINDOW):
    """The automaton over the blocks of all items, its alphabet, and the ids of each window."""
    alphabet, known, half = _Alphabet(), {}, (size + 1) // 2
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for item_id, text in items:
        coded = "".join(map(alphabet.add, _words.findall(text.encode().lower())))
        n_words = len(coded) // _WIDTH
        own = frozenset(() if item_id is None else (item_id,))
        for start in range(max(1, n_words - size + 1) if n_words else 0):
            window = coded[_WIDTH * start : _WIDTH * (start + size)]
            before = known.setdefault(window, own)
            if not own <= before:
                known[window] = before | own
        if 0 < n_words < size:
            automaton.add_word(coded)
        for start in range(0, n_words - half + 1, half) if n_words >= size else ():
            automaton.add_word(coded[_WIDTH * start : _WIDTH * (start + half)])
    automaton.make_automaton()
    return automaton, alphabet, known


@lru_cache(maxsize=1)
def _built(items: tuple, size: int):
    return build(items, size)


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of inclusive intervals, ascending."""
    merged: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def scan(text: str, automaton, alphabet, known, size: int = WINDOW) -> tuple[int, list[tuple[int, int]], set]:
    """Word count, hit runs (inclusive word positions) and items of one text."""
    words = _words.findall(text.encode().lower())
    runs, items = [], set()
    if words and len(automaton):
        half = (size + 1) // 2
        coded = "".join(map(alphabet.__getitem__, words))
        for at_end, length in automaton.iter(coded):
            end, length = at_end // _WIDTH, length // _WIDTH
            first = end - length + 1
            places = [(first, length)] if length < size else []
            if length == half:
                earliest, latest = max(0, end + 1 - size), min(first, len(words) - size)
                places += [(at, size) for at in range(earliest, latest + 1)]
            for at, n in places:
                ids = known.get(coded[_WIDTH * at : _WIDTH * (at + n)])
                if ids is not None:
                    runs.append((at, at + n - 1))
                    items |= ids
    return len(words), merge(runs), items


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point offsets (end exclusive) of word runs in the original text."""
    data = text.encode()
    places = [m.span() for m in _words.finditer(data.lower())]
    spans, done, chars = [], 0, 0
    for first, last in runs:
        ends = []
        for at in (places[first][0], places[last][1]):
            chars, done = chars + len(data[done:at].decode()), at
            ends.append(chars)
        spans.append((ends[0], ends[1]))
    return spans


def _scanner(items: tuple, size: int, id_type: pa.DataType, later: bool):
    """An Arrow function for one automaton; ``later`` adds to what earlier ones found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _built(items.value, size)
        for batch in batches:
            columns = {name: [] for name in ("n_words", "runs", "items", "spans")}
            before = zip(batch["runs"].to_pylist(), batch["items"].to_pylist()) if later else None
            for value in batch["text"]:
                text = value.as_py() or ""
                n_words, runs, found = scan(text, *made, size)
                if later:
                    old_runs, old_items = next(before)
                    runs = merge(runs + [(r["first"], r["last"]) for r in old_runs])
                    found |= set(old_items)
                columns["n_words"].append(n_words)
                columns["runs"].append([{"first": a, "last": b} for a, b in runs])
                columns["items"].append(sorted(found))
                columns["spans"].append(
                    [{"start": a, "end": b} for a, b in offsets(text, runs)] if runs else []
                )
            word = pa.struct([("first", pa.int32()), ("last", pa.int32())])
            char = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"],
                    batch["text"],
                    pa.array(columns["n_words"], pa.int64()),
                    pa.array(columns["runs"], pa.list_(word)),
                    pa.array(columns["items"], pa.list_(id_type)),
                    pa.array(columns["spans"], pa.list_(char)),
                ],
                names=["row", "text", "n_words", "runs", "items", "spans"],
            )

    return run


def _shards(benchmark: DataFrame, words_per_automaton: int) -> Iterator[list[tuple]]:
    """The items in groups whose words fit one automaton; one group is on the driver at a time.

    Groups are packed from small parts of known size. An item of more words than fit makes a
    group beyond that, with what else is in its part.
    """
    n_words = F.regexp_count(
        F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    ).cast("long")
    sized = benchmark.select(
        column("item_id").alias("item_id"), column("text").cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    total = sized.agg(F.sum(n_words)).first()[0] or 0
    if total <= words_per_automaton:
        yield [tuple(row) for row in sized.distinct().collect()]
        return
    parts = PARTS * -(-total // words_per_automaton)
    keyed = staged(
        sized.distinct()
        .withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
        .withColumn("n_words", n_words),
        "benchmark",
    )
    sizes = keyed.groupBy("part").agg(F.sum("n_words").alias("n_words")).orderBy("part").collect()
    first, filled = 0, 0
    ends = []
    for part, size in sizes:
        if filled and filled + size > words_per_automaton:
            ends.append((first, part))
            first, filled = part, 0
        filled += size
    for first, end in [*ends, (first, parts)]:
        within = keyed.where(F.col("part").between(first, end - 1))
        yield [tuple(row) for row in within.select("item_id", "text").collect()]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    keep: Sequence[str] = ("doc_id",),
    size: int = WINDOW,
    words_per_automaton: int = WORDS_PER_AUTOMATON,
) -> DataFrame:
    """Scan ``docs`` (text) for windows of ``benchmark`` (item_id, text).

    Returns per document ``row`` (the columns in ``keep``), ``n_words``, ``n_hit`` (words
    inside any occurrence of a window), ``items`` (sorted ids of the items found) and
    ``spans`` (code-point offsets of the hit passages in the original text). Ids may be of any
    atomic type; ``items`` has the same.

    Documents are not shuffled: every task scans what it reads, and each text goes through
    the automaton once. The benchmark is measured first. Up to ``words_per_automaton`` words
    make one automaton; a larger benchmark makes several, which the documents pass one after
    another, so neither the driver nor a worker ever holds more than that per automaton
    (one item of more words than that excepted).

    Null or empty texts have no words and no hits. Null benchmark texts have no windows; an
    item with a null id counts for hits but is not listed. Repeated items count once. With no
    benchmark at all nothing is hit. Repeated documents each give a row.
    """
    session = docs.sparkSession
    id_type = benchmark.select(column("item_id")).schema[0].dataType
    result = (
        "text string, n_words bigint, runs array<struct<first:int,last:int>>,"
        f" items array<{id_type.simpleString()}>, spans array<struct<start:int,end:int>>"
    )
    found = None
    for items in _shards(benchmark, words_per_automaton):
        shared = session.sparkContext.broadcast(tuple(sorted(items, key=repr)))
        scanner = _scanner(shared, size, to_arrow_type(id_type), found is not None)
        if found is None:
            found = map_texts(docs, keep, scanner, result)
        else:
            found = found.mapInArrow(scanner, with_row(found, result))
    n_hit = F.aggregate(
        "runs", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1
    )
    return found.select("row", "n_words", n_hit.alias("n_hit"), "items", "spans")


def is_contaminated() -> Column:
    """At least one word in twenty lies in a benchmark passage."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
