"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

1. The first pass aligns every text and counts, in each task, how many documents link an A
   id with a B id. Only distinct id pairs and their counts leave a task.
2. The distinct pairs are dealt into shards of bounded size. Each shard gets a minimal perfect
   hash, and its keys stand in the order of their numbers, so that a look-up is verified.
3. Each task's counts become dense vectors, indexed by that hash, which are summed up in a
   tree: 16 vectors at a time, until one is left per shard.
4. The second pass aligns the texts again and looks the counts up. The shards are broadcast in
   blocks of at most ``BLOCK_KEYS`` pairs. There is one pass a block, so no worker ever holds
   more than that, however many pairs the corpus has.

Texts are cut before single spaces between two visible characters, where tokens of both
tokenizers begin, so each distinct piece is encoded once per worker and its groups, links and
counts are added up.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.llm.perfect_hash import PerfectHash, build
from precinct.llm.tables import map_texts, ship_package, staged, text_of, with_row
from precinct.llm.tokens import _is_byte_level

# Pairs per shard on average, pairs per broadcast block, and vectors per sum of the tree.
SHARD_KEYS = 1 << 16
BLOCK_KEYS = 1 << 22
FAN = 16
# Pairs a task of the first pass counts before it writes them out and begins anew.
TASK_PAIRS = 1 << 21
# Pieces a worker remembers and their mean length at most; pieces encoded as one text, and
# texts aligned together.
PIECES = 600_000
PIECE_CHARS = 32
RUN = 256
TEXTS = 256
# Bits of an id; the number of a text goes above two of them.
BITS = 24

_cut = re.compile(r"(?<=[\w!-~])(?= [\w!-~])")
_byte_piece = re.compile(r"<0x([0-9A-F]{2})>")
_UNDERLINE = "▁"
_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint"


def _is_visible(letter: str) -> bool:
    """The same letters as in the pattern above."""
    return "!" <= letter <= "~" or letter.isalnum()


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; faster here than a table of them."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


class Aligned(NamedTuple):
    """Alignments of several pieces. Keys and groups stand one piece after the other."""

    valid: np.ndarray  # whether both tokenizers give the piece back byte by byte
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    keys: np.ndarray  # an id pair for each overlap
    groups: list[str]  # by piece; empty unless asked for


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves; the rest are numbered from 256 on.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Aligns texts by a byte-level tokenizer (A) and a piece model (B)."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        alphabet = _byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, number in self.a.get_vocab().items():
            # Special tokens are no bytes; they never come out of ordinary text.
            known = all(c in alphabet for c in token)
            self.a_bytes[number] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.b_bytes = []
        for piece in map(self.b.id_to_piece, range(self.b.get_piece_size())):
            byte = _byte_piece.fullmatch(piece)
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(_UNDERLINE, " ").encode())
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << BITS:
            raise ValueError(f"ids must be below {1 << BITS}")
        self.a_sizes = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.cuts = _is_byte_level(self.a) and not any(b" " in t.lstrip(b" ") for t in self.b_bytes)

    def pieces(self, text: str) -> list[str]:
        """What ``space + text`` falls into; every piece begins with a space."""
        return _cut.split(" " + text) if self.cuts else [" " + text]

    def align(self, pieces: list[str], with_groups: bool = True) -> Aligned:
        """Align pieces. Invalid ones have no tokens."""
        pieces_bytes = [p.encode() for p in pieces]
        sizes = np.array([len(d) for d in pieces_bytes], np.int64)
        a, b, right = self._encoded(self._runs(pieces), b"".join(pieces_bytes), np.cumsum(sizes))
        valid = np.ones(len(pieces), bool)
        if not right:
            for k, (piece, data) in enumerate(zip(pieces, pieces_bytes)):
                valid[k] = self._encoded([piece], data, sizes[k : k + 1])[2]
            good = [p for p, there in zip(pieces, valid) if there]
            a, b, _ = self._encoded(good, b"", sizes[:0])
        return self._matched(a, b, np.where(valid, sizes, 0), valid, with_groups)

    def _runs(self, pieces: list[str]) -> list[str]:
        """Pieces joined again where they may be cut, because few long texts are encoded faster."""
        if not self.cuts:
            return pieces
        runs, own = [], []
        for piece in pieces:
            joins = len(piece) > 1 and piece[0] == " " and _is_visible(piece[1])
            if own and not (joins and len(own) < RUN and _is_visible(own[-1][-1])):
                runs.append("".join(own))
                own = []
            own.append(piece)
        return [*runs, "".join(own)] if own else runs

    def _encoded(self, texts: list[str], data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of all texts, and whether they give ``data`` with a token ending at all ``ends``."""
        ones = self.a.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        others = self.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        a = np.fromiter(chain.from_iterable(one.ids for one in ones), np.int64)
        b = np.fromiter(chain.from_iterable(others), np.int64)
        right = True
        for ids, parts, lengths in ((a, self.a_bytes, self.a_sizes), (b, self.b_bytes, self.b_sizes)):
            right = (
                right
                and b"".join(map(parts.__getitem__, ids.tolist())) == data
                and bool(lengths[ids].all())
                and bool(np.isin(ends, np.cumsum(lengths[ids]), assume_unique=True).all())
            )
        return a, b, right

    def _matched(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, valid: np.ndarray, with_groups: bool) -> Aligned:
        a_ends, b_ends, piece_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), np.cumsum(sizes)
        # Between two ends of either kind there is one token of each: an overlap.
        ends = _distinct(np.concatenate([a_ends, b_ends]))
        i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        count = lambda at: np.bincount(np.searchsorted(piece_ends, at), minlength=len(sizes))
        both = (a_ends[i] == ends) & (b_ends[j] == ends) if len(ends) else np.empty(0, bool)
        n_groups, groups = count(ends[both]), []
        if with_groups:
            ones, others = list(map(str, a.tolist())), list(map(str, b.tolist()))
            parts, x, y = [], 0, 0
            for up_to_a, up_to_b in zip((i[both] + 1).tolist(), (j[both] + 1).tolist()):
                parts.append(",".join(ones[x:up_to_a]) + "|" + ",".join(others[y:up_to_b]))
                x, y = up_to_a, up_to_b
            stops = np.cumsum(n_groups).tolist()
            groups = [";".join(parts[x:y]) for x, y in zip([0, *stops], stops)]
        keys = (a[i] << BITS | b[j]) if len(ends) else np.empty(0, np.int64)
        return Aligned(valid, count(a_ends), count(b_ends), n_groups, count(ends), keys, groups)


@lru_cache(maxsize=2)
def aligner(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


class _Memory:
    """Pieces a worker has aligned: their keys one after the other, numbers, and groups."""

    def __init__(self, own: Aligner, lookup: _Lookup | None = None):
        self.own, self.lookup = own, lookup
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars, self.all_valid = 0, True
        self.keys = np.empty(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.numbers = np.zeros((0, 6), np.int64)
        self.groups: list[str] = []

    def add(self, pieces: list[str]) -> list[int]:
        """Align pieces and return their places; -1 for those that are not valid."""
        found = self.own.align(pieces, self.lookup is not None)
        first = len(self.starts) - 1
        if self.lookup is None:
            self.keys = np.concatenate([self.keys, found.keys])
        else:
            sums = self.lookup.sums(found)
            basic = (found.n_a, found.n_b, found.n_groups, found.n_links)
            self.numbers = np.concatenate([self.numbers, np.column_stack([*basic, *sums])])
            self.groups += found.groups
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(found.n_links)])
        return np.where(found.valid, np.arange(first, first + len(pieces)), -1).tolist()

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The places of the pieces of all texts, and where each text's begin and end."""
        if len(self.known) > PIECES or self.chars > PIECES * PIECE_CHARS:
            self.clear()
        cut = [self.own.pieces(t) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in self.known]
        added = self.add(new)
        self.known.update(zip(new, added))
        self.all_valid &= -1 not in added
        self.chars += sum(map(len, new))
        places = []
        for text, pieces in zip(texts, cut):
            own = list(map(self.known.__getitem__, pieces))
            if not self.all_valid and -1 in own:
                # Only the whole text decides whether its bytes come back.
                own = self.add([" " + text])
                own = [] if own[0] < 0 else own
            places.append(own)
        bounds = np.r_[0, np.cumsum([len(own) for own in places])].astype(np.int64)
        return np.fromiter(chain.from_iterable(places), np.int64, int(bounds[-1])), bounds

    def distinct_keys(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The keys of all texts, each as often as texts have it."""
        lengths = self.starts[places + 1] - self.starts[places]
        before = np.cumsum(lengths) - lengths
        at = np.repeat(self.starts[places] - before, lengths) + np.arange(lengths.sum())
        text = np.repeat(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), lengths)
        return _distinct(text << (2 * BITS) | self.keys[at]) & ((1 << 2 * BITS) - 1)


_kept: dict[tuple, _Memory] = {}


def _remembered(name: tuple, make) -> _Memory:
    """The memory a worker goes on with from task to task, one at a time."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def _merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add one to the count of a key for each time it is in ``more``."""
    more = np.sort(more)
    starts = np.flatnonzero(np.r_[True, more[1:] != more[:-1]]) if len(more) else np.empty(0, np.int64)
    new, times = more[starts], np.diff(np.r_[starts, len(more)])
    at = np.searchsorted(keys, new)
    there = keys[np.minimum(at, len(keys) - 1)] == new if len(keys) else np.zeros(len(new), bool)
    counts = counts.copy()
    counts[at[there]] += times[there]
    if not there.all():
        keys, counts = np.insert(keys, at[~there], new[~there]), np.insert(counts, at[~there], times[~there])
    return keys, counts


def _pair_counter(byte_file: str, piece_file: str):
    """Pairs and the documents that link them, per ``chunk``: what a task counted at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _remembered((byte_file, piece_file), lambda: _Memory(aligner(byte_file, piece_file)))
        task, chunk = TaskContext.get().partitionId(), 0
        none = np.empty(0, np.int64)
        keys, counts = none, none

        def written() -> pa.RecordBatch:
            chunks = np.full(len(keys), task << 24 | chunk, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(chunks), pa.array(keys), pa.array(counts)], names=["chunk", "pair", "n"]
            )

        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                texts = batch["text"].slice(start, TEXTS).to_pylist()
                keys, counts = _merged(keys, counts, memory.distinct_keys(*memory.texts(texts)))
                if len(keys) > TASK_PAIRS:
                    yield written()
                    keys, counts, chunk = none, none, chunk + 1
        yield written()

    return run


def _shard(pair: Column, shards: int) -> Column:
    a, b = F.shiftright(pair, BITS), pair.bitwiseAND(F.lit((1 << BITS) - 1))
    return (a * F.lit(2654435761) + b * F.lit(2246822519)) % F.lit(shards)


def _shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> BITS) * 2654435761 + (keys & ((1 << BITS) - 1)) * 2246822519) % shards


def _hashed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The perfect hash of a shard, and its keys by number."""
    keys = table["pair"].to_numpy()
    sizes, bits = build(keys)
    in_order = np.empty_like(keys)
    in_order[PerfectHash(sizes, bits).numbers(keys)] = keys
    return pa.table(
        {
            "shard": [key[0].as_py()], "n": [len(keys)], "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "bits": [bits], "keys": [in_order.tobytes()],
        }
    )


_HASHED = "shard bigint, n bigint, sizes array<bigint>, bits binary, keys binary"
_VECTOR = "shard bigint, branch bigint, counts binary"


def _vectors(key: tuple[pa.Scalar, ...], partials: pa.Table, hashed: pa.Table) -> pa.Table:
    """The counts of one branch of the tree as a dense vector over its shard."""
    if not len(partials):
        return pa.table({"shard": pa.array([], pa.int64()), "branch": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
    row = hashed.to_pylist()[0]
    counts = np.zeros(row["n"], np.int64)
    pairs = partials["pair"].to_numpy()
    numbers = PerfectHash(row["sizes"], row["bits"]).numbers(pairs)
    if (numbers < 0).any() or (np.frombuffer(row["keys"], np.int64)[numbers] != pairs).any():
        raise RuntimeError("a pair is not in its shard")
    np.add.at(counts, numbers, partials["n"].to_numpy())
    return pa.table({"shard": [key[0].as_py()], "branch": [key[1].as_py()], "counts": [counts.tobytes()]})


def _summed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v.as_py(), np.int64) for v in table["counts"]], axis=0, dtype=np.int64)
    return pa.table({"shard": [key[0].as_py()], "branch": [key[1].as_py()], "counts": [total.tobytes()]})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch["keys"], batch["counts"]):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(keys.as_py(), np.int64)),
                    pa.array(np.frombuffer(counts.as_py(), np.int64)),
                ],
                names=["pair", "n"],
            )


class PairCounts(NamedTuple):
    """``shards`` has a row per shard: hash, keys and counts, both by number."""

    shards: DataFrame
    n_shards: int

    def table(self) -> DataFrame:
        """(a, b, n_documents) for every id pair that a document links."""
        pairs = self.shards.select("keys", "counts").mapInArrow(_unpacked, "pair bigint, n bigint")
        low = F.lit((1 << BITS) - 1)
        return pairs.select(
            F.shiftright("pair", BITS).alias("a"), F.col("pair").bitwiseAND(low).alias("b"), F.col("n").alias("n_documents")
        )


def count_pairs(
    docs: DataFrame, byte_file: str, piece_file: str, *, shard_keys: int = SHARD_KEYS, fan: int = FAN
) -> PairCounts:
    """How many documents of ``docs`` (text) link each pair of ids."""
    ship_package(docs.sparkSession)
    partials = staged(
        docs.select(text_of(docs).alias("text")).mapInArrow(
            _pair_counter(byte_file, piece_file), "chunk bigint, pair bigint, n bigint"
        ),
        "pair-counts",
    )
    pairs = staged(partials.select("pair").distinct(), "pairs")
    n_shards = max(1, -(-pairs.count() // shard_keys))
    shard = _shard(F.col("pair"), n_shards).alias("shard")
    hashed = staged(pairs.select("pair", shard).groupBy("shard").applyInArrow(_hashed, _HASHED), "pair-hashes")
    branches = max(1, -(-partials.agg(F.countDistinct("chunk")).first()[0] // fan))
    branch = F.pmod(F.xxhash64("chunk"), F.lit(branches)).cast("long").alias("branch")
    every_branch = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(branches - 1).cast("long")))
    vectors = (
        partials.select("pair", "n", shard, branch)
        .groupBy("shard", "branch")
        .cogroup(hashed.withColumn("branch", every_branch).groupBy("shard", "branch"))
        .applyInArrow(_vectors, _VECTOR)
    )
    while branches > 1:
        branches = -(-branches // fan)
        vectors = (
            vectors.withColumn("branch", F.floor(F.col("branch") / F.lit(fan)))
            .groupBy("shard", "branch")
            .applyInArrow(_summed, _VECTOR)
        )
    counted = hashed.join(vectors.drop("branch"), "shard")
    return PairCounts(staged(counted, "counted-pairs"), n_shards)


class _Lookup:
    """Counts of the pairs of one block of shards."""

    def __init__(self, rows: list[tuple], best: np.ndarray, n_shards: int):
        self.n_shards, self.best = n_shards, best
        self.shards = {
            shard: (PerfectHash(sizes, bits), np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64))
            for shard, sizes, bits, keys, counts in rows
        }

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 where its shard is in another block."""
        found = np.zeros(len(keys), np.int64)
        shards = _shards_of(keys, self.n_shards)
        order = np.argsort(shards, kind="stable")
        names, starts = np.unique(shards[order], return_index=True)
        for name, part in zip(names.tolist(), np.split(order, starts[1:])):
            if name in self.shards:
                hashed, own, counts = self.shards[name]
                numbers = hashed.numbers(keys[part])
                if (numbers < 0).any() or (own[numbers] != keys[part]).any():
                    raise RuntimeError("the documents have changed between the two passes")
                found[part] = counts[numbers]
        return found

    def sums(self, found: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """Best links and counts per piece."""
        counts = self.counts(found.keys)
        is_best = (counts > 0) & (counts == self.best[found.keys >> BITS])
        ends = np.cumsum(found.n_links)
        starts = ends - found.n_links
        totals = [np.r_[0, np.cumsum(each)] for each in (is_best, counts)]
        return tuple(total[ends] - total[starts] for total in totals)


def _second_pass(byte_file: str, piece_file: str, block, later: bool):
    """Add the numbers of one block; the first one also gives the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows, best, n_shards = block.value
        lookup = lambda: _Lookup(rows, np.frombuffer(best, np.int64), n_shards)
        memory = _remembered((name,), lambda: _Memory(aligner(byte_file, piece_file), lookup()))
        names = [field.split()[0] for field in _COUNTS.split(", ")]
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                places, bounds = memory.texts(part["text"].to_pylist())
                totals = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(memory.numbers[places], axis=0)])
                numbers = totals[bounds[1:]] - totals[bounds[:-1]]
                groups = [";".join([memory.groups[k] for k in places[x:y].tolist()]) for x, y in zip(bounds, bounds[1:])]
                made = {name: pa.array(numbers[:, k]) for k, name in enumerate(names)}
                if later:
                    for name in names[:4]:
                        made[name] = part[name]
                    for k, name in enumerate(names[4:], start=4):
                        made[name] = pa.array(part[name].to_numpy() + numbers[:, k])
                made["groups"] = part["groups"] if later else pa.array(groups, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part["row"], part["text"], *made.values()], names=["row", "text", *made]
                )

    return run


def align(
    docs: DataFrame,
    byte_file: str,
    piece_file: str,
    *,
    keep: Sequence[str] = ("doc_id",),
    shard_keys: int = SHARD_KEYS,
    block_keys: int = BLOCK_KEYS,
    fan: int = FAN,
) -> DataFrame:
    """Align the tokens of ``docs`` (text) by a byte-level tokenizer A and a piece model B.

    Returns per document ``row`` (the columns in ``keep``), the numbers of tokens ``n_a`` and
    ``n_b``, ``n_groups`` (byte ranges where tokens of both begin and end), ``n_links`` (pairs
    of overlapping tokens), ``n_best`` (links whose pair is linked in as many documents as any
    pair of its A id), ``count_sum`` (documents that link a pair, summed over the links) and
    ``groups``: decimal ids, ``a1,a2|b1;a3|b2,b3``.

    Both files must be readable by every executor. Nothing is shuffled but distinct pairs and
    their counts. A worker holds one block of ``block_keys`` pairs, some 20 bytes each; the
    documents pass through once for each block.

    A null or empty text, or one that either tokenizer does not give back byte by byte, has no
    tokens: zeros and empty ``groups``. Repeated rows are documents of their own, each counted.
    An empty table gives no rows. Texts of any length are aligned whole.
    """
    spark = docs.sparkSession
    counted = count_pairs(docs, byte_file, piece_file, shard_keys=shard_keys, fan=fan)
    # At most one row for each id of A's vocabulary.
    highest = counted.table().groupBy("a").agg(F.max("n_documents").alias("n")).collect()
    best = np.zeros(1 + max((r.a for r in highest), default=0), np.int64)
    for r in highest:
        best[r.a] = r.n
    blocks, filled = [[]], 0
    for r in counted.shards.select("shard", "n").orderBy("shard").collect():
        if filled and filled + r.n > block_keys:
            blocks.append([])
            filled = 0
        blocks[-1].append(r.shard)
        filled += r.n
    found = None
    for shards in blocks:
        own = counted.shards.where(F.col("shard").between(shards[0], shards[-1])) if shards else counted.shards
        rows = [tuple(r) for r in own.select("shard", "sizes", "bits", "keys", "counts").collect()]
        rows = [(s, list(sizes), bytes(bits), bytes(keys), bytes(counts)) for s, sizes, bits, keys, counts in rows]
        block = spark.sparkContext.broadcast((uuid.uuid4().hex, rows, best.tobytes(), counted.n_shards))
        schema = f"text string, {_COUNTS}, groups string"
        run = _second_pass(byte_file, piece_file, block, found is not None)
        if found is None:
            found = map_texts(docs, keep, run, schema)
        else:
            # Written first, so that only one block is in use at a time.
            found = staged(found, "aligned")
            last.unpersist()
            found = found.mapInArrow(run, with_row(found, schema))
        last = block
    return found.drop("text")
