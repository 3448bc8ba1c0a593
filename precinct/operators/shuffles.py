"""Many seeded shuffles of one table, a stretch of one order at a time.

A sort of rows times shuffles writes, compares and joins each row with its digest as text. Here
rows travel packed: Spark deals the digests of a shuffle into stretches by their first bits, and
tasks sort a stretch as an array. Only the lengths of the stretches are needed to know where
each begins; after that a row is its number alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.sources.shared import staged

# Rows of a stretch, pairs of a block and rows packed at once.
STRETCH = 1 << 20
# Shuffles that meet a block of the first order in one task.
TOGETHER = 4
ROW = np.dtype([("high", "<u8"), ("low", "<u8"), ("number", "<i8")])
PACKED = "b int, part bigint, rows binary"
ORDERED = "b int, part bigint, n bigint, numbers binary"
MET = "b int, l bigint, r bigint, o bigint"


def _packer(bits: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs the rows of each shuffle whose digests share their first ``bits``."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        digests = pa.concat_arrays(table["digest"].cast(pa.binary(16)).chunks)
        words = np.frombuffer(digests.buffers()[1], ">u8")[2 * digests.offset :][: 2 * len(digests)].reshape(-1, 2)
        rows = np.empty(len(words), ROW)
        rows["high"], rows["low"], rows["number"] = words[:, 0], words[:, 1], table["number"].to_numpy()
        # In two steps, because no shift is as wide as the word.
        part = (rows["high"] >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
        group = (table["b"].to_numpy().astype(np.int64) << bits) | part
        order = np.argsort(group, kind="stable")
        rows, group = rows[order], group[order]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        blobs = [rows[i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(rows)])]
        b = (group[starts] >> bits).astype(np.int32)
        part = group[starts] & ((1 << bits) - 1)
        return pa.record_batch([pa.array(b), pa.array(part), pa.array(blobs, pa.binary())], names=["b", "part", "rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return pack


def _sorter() -> Callable[[pa.Table], pa.Table]:
    """Puts the numbers of a stretch in the order of their digests; equal ones by number."""

    def ordered(table: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(table["rows"].to_pylist()), ROW)
        high = np.ascontiguousarray(rows["high"])
        order = np.argsort(high)
        high = high[order]
        if (high[1:] == high[:-1]).any():
            order = np.lexsort((rows["number"], rows["low"], rows["high"]))
        numbers = pa.array([rows["number"][order].tobytes()], pa.binary())
        n = pa.array([len(rows)], pa.int64())
        return pa.table([table["b"][:1].combine_chunks(), table["part"][:1].combine_chunks(), n, numbers], names=["b", "part", "n", "numbers"])

    return ordered


def _counter(n: int) -> Callable[[pa.Table], pa.Table]:
    """Counts the pairs of numbers below ``n`` that meet in a block of places."""
    schema = pa.schema([("b", pa.int32()), ("l", pa.int64()), ("r", pa.int64()), ("o", pa.int64())])

    def met(table: pa.Table) -> pa.Table:
        pieces: dict[int, list[np.ndarray]] = {}
        for row in table.select(["b", "place", "numbers"]).sort_by("place").to_pylist():
            pieces.setdefault(row["b"], []).append(np.frombuffer(row["numbers"], "<i8"))
        left = np.concatenate(pieces.pop(0)) * n
        found = [schema.empty_table()]
        for b, numbers in pieces.items():
            cells, o = np.unique(left + np.concatenate(numbers), return_counts=True)
            columns = [np.full(len(cells), b, np.int32), cells // n, cells % n, o]
            found.append(pa.table([pa.array(c) for c in columns], schema=schema))
        return pa.concat_tables(found)

    return met


def shuffled_cells(
    pairs: DataFrame, digest: Column, *, left: str, right: str, n: int, shuffles: int, stretch: int = STRETCH
) -> DataFrame:
    """How many pairs have each two numbers (``l``, ``r``) in shuffle ``b``, as ``o``.

    ``digest`` gives a pair 16 bytes for each ``b`` from 0 to ``shuffles``. The left numbers
    stand in the order of the digests of 0, and meet the right ones in that of the digests of
    ``b``. There are ``n`` pairs, and numbers are from 0 to ``n`` - 1, so ``n`` may be 3e9.

    No task has more than some ``stretch`` rows in memory, except that equal digests stay
    together. The ordered numbers go to the shared folder, and are cut there into blocks of
    places; ``TOGETHER`` shuffles meet a block of the left numbers in one task.
    """
    spark = pairs.sparkSession
    bits = max(0, (n - 1).bit_length() - (stretch.bit_length() - 1))
    tasks = max(spark.sparkContext.defaultParallelism, -(-n * (shuffles + 1) // (4 * STRETCH)))
    every = pairs.repartition(tasks).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(shuffles))))
    number = F.when(F.col("b") == 0, F.col(left)).otherwise(F.col(right))
    packed = every.select("b", digest.alias("digest"), number.alias("number")).mapInArrow(_packer(bits, STRETCH), PACKED)
    ordered = staged(packed.groupBy("b", "part").applyInArrow(_sorter(), ORDERED), "shuffles")

    lengths = ordered.select("b", "part", "n")
    before = F.sum("n").over(Window.partitionBy("b").orderBy("part")) - F.col("n")
    begun = ordered.join(lengths.select("b", "part", before.alias("before")), ["b", "part"])
    last = F.expr(f"(before + n - 1) DIV {stretch}")
    cut = begun.withColumn("block", F.explode(F.sequence(F.expr(f"before DIV {stretch}"), last)))
    start = F.greatest(F.col("block") * stretch - F.col("before"), F.lit(0))
    end = F.least((F.col("block") + 1) * stretch - F.col("before"), F.col("n"))
    width = ROW["number"].itemsize
    piece = F.substring("numbers", (start * width + 1).cast("int"), ((end - start) * width).cast("int"))
    teams = F.when(F.col("b") == 0, F.sequence(F.lit(0), F.lit(max(shuffles - 1, 0) // TOGETHER)))
    teams = teams.otherwise(F.array(F.expr(f"CAST((b - 1) DIV {TOGETHER} AS INT)")))
    pieces = cut.select("block", F.explode(teams).alias("team"), "b", (F.col("before") + start).alias("place"), piece.alias("numbers"))
    met = pieces.groupBy("block", "team").applyInArrow(_counter(n), MET)
    return met.groupBy("b", "l", "r").agg(F.sum("o").alias("o"))
