"""Token counts through a digest cache.

A text is known by the digest of its content and of the tokenizer file. Counts are looked
up by that digest; only contents the cache lacks are encoded, each once however many
documents hold it, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.llm.tables import column, ship_package, staged, text_of

CACHE_SCHEMA = "digest string, n_tokens bigint"
# Pieces whose counts a worker remembers; the memory starts again when it is full.
PIECES = 500_000
# Misses whose digests are broadcast, 64 bytes each.
FEW = 100_000

# A byte-level tokenizer starts a new unit at a single space between two characters that are
# not white space, so a text may be cut there and counted by its pieces.
_cut = re.compile(r"(?<=[\w!-~])(?= [\w!-~])")


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _is_byte_level(tokenizer) -> bool:
    """Whether nothing but a byte-level pattern splits texts, so that pieces add up."""
    import json

    state = json.loads(tokenizer.to_str())
    split = state.get("pre_tokenizer") or {}
    return (
        state.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and split.get("use_regex", True)
        and state.get("truncation") is None
        and state.get("padding") is None
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
            for t in state.get("added_tokens", [])
        )
    )


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a .json or .model file.

    Counts are those of the file's own library over the whole text, without begin, end or
    other added special tokens, truncation or padding. For byte-level files the library
    encodes the distinct space-led pieces of the texts, whose counts add up to the same.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)] if texts else []
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if not _is_byte_level(tokenizer):
        return encode
    known: dict[str, int] = {}

    def by_pieces(texts: list[str]) -> list[int]:
        if len(known) > PIECES:
            known.clear()
        counts = []
        for text in texts:
            pieces = _cut.split(text)
            new = [p for p in dict.fromkeys(pieces) if p not in known]
            known.update(zip(new, encode(new)))
            counts.append(sum(map(known.__getitem__, pieces)))
        return counts

    return by_pieces


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            counts = []
            for start in range(0, batch.num_rows, 64):
                counts += count(batch["text"].slice(start, 64).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["digest"], pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    return run


def content_digest(text: Column, version: str) -> Column:
    """Digest of normalised content (null is empty) and tokenizer version."""
    return F.sha2(F.concat(F.lit(version + "\n"), F.coalesce(text, F.lit(""))), 256)


def _read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, empty where nothing was written to it yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    *,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``row`` (the columns in ``keep``), ``n_bytes`` and ``n_tokens`` of every whole text.

    ``tokenizer`` is a file every executor can read, ``cache`` a Parquet folder in shared
    storage that may be used again for any documents and tokenizers.

    Each content the cache lacks is encoded once: partial aggregates keep one text a digest
    before anything is shuffled, so a content of very many rows never meets in one task. Up to
    ``FEW`` misses are broadcast as digests, so that the other texts stay where they are. A run
    that fails before the append leaves the cache as it was, and one without misses writes
    nothing. Repeated digests in the cache, as two concurrent runs can leave, are counted once.

    Null text counts as empty, with 0 tokens. Repeated documents each give a row, and an
    empty table gives none.
    """
    spark = docs.sparkSession
    ship_package(spark)
    version = tokenizer_digest(tokenizer)
    text = F.coalesce(text_of(docs), F.lit(""))
    digest = content_digest(text, version)
    # Narrow: no text.
    digests = staged(
        docs.select(
            F.struct(*[column(name) for name in keep]).alias("row"),
            digest.alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
        ),
        "digests",
    )
    known = _read_cache(spark, cache).select("digest")
    misses = staged(digests.select("digest").distinct().join(known, "digest", "left_anti"), "misses")
    n_misses = misses.count()
    if n_misses:
        texts = docs.select(digest.alias("digest"), text.alias("text"))
        if n_misses <= FEW:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        encoded = (
            texts.groupBy("digest")
            .agg(F.first("text").alias("text"))
            .join(misses, "digest", "left_semi")
            .mapInArrow(_encoder(tokenizer), CACHE_SCHEMA)
        )
        encoded.write.mode("append").parquet(cache)
    counts = (
        _read_cache(spark, cache).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    )
    return digests.join(staged(counts, "counts"), "digest").select("row", "n_bytes", "n_tokens")
