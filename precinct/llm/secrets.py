"""Secret scans: pattern spans plus sliding-window entropy, in SQL functions only.

Spark has no function for the places of all matches of a pattern. They follow from
splitting a text at the matches: the lengths of the pieces and of the matches, summed up in
turn, give every start and end. All work stays inside the row, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.llm.tables import column, text_of

# The base patterns, letters of the key words in either case.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A run of 16 or more is what is left of all runs once shorter ones are dropped, and the
# same holds for AKIA and 14 or more: a later start inside a run only gives a shorter match.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
# Classes searched by entropy: characters, and the least bits per character of a window.
# 20 random hex digits have 3.3 bits on average and 20 random base-64 digits 4.1; prose
# without spaces stays below 3.5.
ENTROPY_CLASSES = {
    "hex_entropy": ("A-Fa-f0-9", 2.8),
    "base64_entropy": ("A-Za-z0-9+/_=-", 3.75),
}
# Candidates that are never secrets: words and paths, numbers, UUIDs, and runs of one
# repeated unit. Words are of one case but for a capital at the start, joined by the signs of
# the class, with two digits at most, each at the end of a word ("file_v2", "part-12/of");
# up to 200 words may have a capital each, and up to 40 of four letters or more be joined by
# nothing else ("StringBuilderFactory"). Longer ones, other mixtures of cases and digits
# inside words are left to the entropy.
_JOIN = "+/_=-"
_NUMBER = "(?:(?:[0-9]{{1,2}}|[0-9][{j}][{c}{j}]*[0-9])(?:[{j}][{c}{j}]*)?)?"
_LOWER, _UPPER = (_NUMBER.format(c=c, j=_JOIN) for c in ("a-z", "A-Z"))
ALLOW = (
    f"^[A-Z]?[a-z{_JOIN}]*{_LOWER}$",
    f"^[A-Z{_JOIN}]*{_UPPER}$",
    f"^(?:[A-Z]?[a-z]*[{_JOIN}]){{1,200}}[A-Z]?[a-z]*[0-9]{{0,2}}$",
    r"^[A-Z]?[a-z]+(?:[A-Z][a-z]{3,}){1,40}$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(.{1,8})\1+$",
)

KINDS = ("assign", "access", "hex", *ENTROPY_CLASSES)
_SPAN = "struct<start:int,rank:int,end:int,value:string>"
# Entropy sums count in millionths of a bit, so that they are exact and equal everywhere.
_UNIT = 1_000_000


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; a plain name would repeat the work."""
    return F.transform(F.array(value), body)[0]


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def match_spans(text: Column, pattern: str, rank: int) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, rank, end, value>>."""

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        span = F.struct(
            start.alias("start"),
            F.lit(rank).alias("rank"),
            end.alias("end"),
            pair["match"].alias("value"),
        )
        return F.struct(end.alias("at"), F.array_append(state["spans"], span).alias("spans"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)),
        found,
        lambda piece, match: F.struct(piece.alias("piece"), match.alias("match")),
    )
    begin = F.struct(F.lit(0).alias("at"), _empty(_SPAN).alias("spans"))
    places = F.aggregate(pairs, begin, step, lambda state: state["spans"])
    return F.when(text.rlike(pattern), places).otherwise(_empty(_SPAN))


def high_entropy(candidate: Column, threshold: float, window: int = WINDOW) -> Column:
    """Whether any window of an ASCII string has at least ``threshold`` bits a character.

    The counts of a window follow from those of the one before it: one character leaves and
    one enters. The sum of c * log2(c) over the counts is kept up to date the same way, and
    the entropy of a full window is log2(window) minus that sum over the window's length.
    """
    weights = F.array(
        *[F.lit(round(c * math.log2(c) * _UNIT) if c else 0) for c in range(window + 2)]
    )
    most = math.floor((math.log2(window) - threshold) * window * _UNIT)

    def slide(codes: Column, weights: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            entering = F.get(codes, i)
            leaving = F.when(i >= window, F.get(codes, i - window)).otherwise(-1)
            counts, total = state["counts"], state["total"]
            left = F.coalesce(F.get(counts, leaving), F.lit(0))
            same = entering == leaving
            there = F.get(counts, entering)
            moved = F.transform(
                counts,
                lambda c, k: c
                + F.when(k == entering, 1).otherwise(0)
                - F.when(k == leaving, 1).otherwise(0),
            )
            change = (
                F.get(weights, there + 1)
                - F.get(weights, there)
                + F.when(leaving >= 0, F.get(weights, left - 1) - F.get(weights, left)).otherwise(0)
            )
            new_total = F.when(same, total).otherwise(total + change)
            return F.struct(
                F.when(same, counts).otherwise(moved).alias("counts"),
                new_total.alias("total"),
                (state["hit"] | ((i >= window - 1) & (new_total <= most))).alias("hit"),
            )

        begin = F.struct(
            F.array_repeat(F.lit(0), 128).alias("counts"),
            F.lit(0).alias("total"),
            F.lit(False).alias("hit"),
        )
        return F.aggregate(
            F.sequence(F.lit(0), F.size(codes) - 1), begin, step, lambda state: state["hit"]
        )

    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    return _let(codes, lambda c: _let(weights, lambda w: slide(c, w)))


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def _outside(spans: Column):
    """What is left of a candidate outside of ``spans``, which are sorted by start."""

    def cut(s: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            value = F.substring(s["value"], start - s["start"] + 1, end - start)
            made = F.struct(
                start.alias("start"), s["rank"].alias("rank"), end.alias("end"), value.alias("value")
            )
            return F.when(end - start >= WINDOW, F.array(made)).otherwise(_empty(_SPAN))

        def step(state: Column, found: Column) -> Column:
            return F.struct(
                F.greatest(state["at"], found["end"]).alias("at"),
                F.concat(state["pieces"], piece(state["at"], found["start"])).alias("pieces"),
            )

        begin = F.struct(s["start"].alias("at"), _empty(_SPAN).alias("pieces"))
        within = F.filter(spans, lambda f: (f["start"] < s["end"]) & (f["end"] > s["start"]))
        pieces = F.aggregate(
            within, begin, step, lambda state: F.concat(state["pieces"], piece(state["at"], s["end"]))
        )
        return F.when(_overlaps(spans, s["start"], s["end"]), pieces).otherwise(F.array(s))

    return cut


def _is_secret(threshold: float, allow: Sequence[str]):
    """A test of candidates: on no allow list, and with a window of high entropy."""

    def test(s: Column) -> Column:
        listed = F.lit(False)
        for pattern in allow:
            listed = listed | s["value"].rlike(pattern)
        return F.when(~listed, high_entropy(s["value"], threshold)).otherwise(F.lit(False))

    return test


def of_kind(spans: Column, rank: int) -> Column:
    """How many spans are of one kind."""
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def find_secrets(
    docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), allow: Sequence[str] = ALLOW
) -> DataFrame:
    """The secrets in the texts of ``docs``, one row per document.

    Returns ``row`` (the columns in ``keep``), ``text`` and the arrays ``base_spans`` and
    ``spans`` of (start, rank, end, value). Offsets are code points, ends exclusive; ``rank``
    is the place of the kind in ``KINDS``. Base spans are those of the three patterns and
    always stay. ``spans`` adds the maximal runs of each entropy class with a window above
    its threshold, unless an allow-list pattern matches the run. Of a run that overlaps spans
    found before, each piece outside them counts as a run. Both are sorted by start, then rank.

    Null text counts as empty, and texts are scanned whole. Every document keeps its row,
    repeated ones too; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = F.filter(
        match_spans(text, ASSIGN, 0),
        lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12,
    )
    base = F.concat(assigned, match_spans(text, ACCESS, 1), match_spans(text, HEX, 2))
    found = docs.select(
        F.struct(*[column(name) for name in keep]).alias("row"), text_of(docs).alias("text")
    ).select("row", "text", F.sort_array(base).alias("base_spans"))
    found = found.withColumn("spans", F.col("base_spans"))
    for rank, (chars, threshold) in enumerate(ENTROPY_CLASSES.values(), start=3):
        pattern = f"(?<![{chars}])[{chars}]{{{WINDOW},}}+"
        pieces = F.flatten(F.transform(F.col("candidates"), _outside(F.col("spans"))))
        secret = F.filter(pieces, _is_secret(threshold, allow))
        added = F.sort_array(F.concat("spans", secret))
        more = F.when(F.size("candidates") == 0, F.col("spans")).otherwise(added)
        found = (
            found.withColumn("candidates", match_spans(text, pattern, rank))
            .withColumn("spans", more)
            .drop("candidates")
        )
    return found


def describe(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with every span replaced; overlapping spans are replaced together."""

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        fresh = span["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["out"], gap, F.lit(mark)))
            .otherwise(state["out"])
            .alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(
            spans, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
        )
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all secrets of its texts replaced and ``n_chars`` brought up to date.

    Documents without a secret, null texts included, come through unchanged.
    """
    found = find_secrets(docs, keep=docs.columns)
    clean = found.withColumn("clean", redacted(F.col("text"), F.col("spans")))
    hit = F.size("spans") > 0
    fixed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        fixed["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    old = F.col("row")
    return clean.select(
        *[
            (F.when(hit, fixed[c]).otherwise(old[c]) if c in fixed else old[c]).alias(c)
            for c in docs.columns
        ]
    )
