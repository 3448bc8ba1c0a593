"""Chat formatting into windows of a token budget, in SQL functions only.

Prefix sums of turn tokens place every turn on a line that is ruled into cells of the
window's capacity. Turns that begin and end in one cell fit a window together. A turn that
crosses into the next cell joins them if the sum still fits, and is a window of its own
otherwise. So windows keep to the budget without any pass from turn to turn; only a turn
that is larger than the budget exceeds it, and is kept whole and alone.

Each window repeats the system turn and the last turns before it, up to a limit. Repeats only
take what the budget leaves: a long system turn shortens the history, one of more than three
quarters of the budget is a window of its own and not repeated, and a turn that would exceed
the budget beside the system turn stands without it. The loss mask covers the assistant texts of a window's own turns, so each is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precinct.llm.tables import column, staged

# Marks of the template.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# What is escaped inside roles and texts, the template's marks and those of
# common other templates: a first character and the rest.
_REST = r"(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>|/?INST\])"
_PLAIN = r"([<\[])(\\*)" + _REST
_ESCAPED = r"([<\[])\\(\\*)" + _REST

BUDGET = 512
HISTORY = 64
BLOCK = 64  # turns whose prefix sums are taken together
SYSTEM, ASSISTANT = "system", "assistant"


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of every control string."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def turn_tokens(text: Column) -> Column:
    """Words of a turn, and one for its marks."""
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _placed_turns(turns: DataFrame) -> DataFrame:
    """Turns with the tokens before them in their conversation, ``at``, and their ``place``.

    Sums run within blocks of turn numbers and over the blocks' totals, so a conversation
    with very many turns is not one window partition.
    """
    conv, turn = column("conv_id"), column("turn").cast("long")
    text = F.coalesce(column("text").cast("string"), F.lit(""))
    rows = staged(
        turns.select(
            conv.alias("conv_id"),
            F.when(conv.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), conv.cast("string"))).alias("conv"),
            F.coalesce(F.floor(turn / BLOCK), F.lit((1 << 62))).alias("block"),
            turn.alias("turn"),
            F.coalesce(column("role").cast("string"), F.lit("")).alias("role"),
            text.alias("text"),
            turn_tokens(text).alias("tokens"),
        ),
        "turns",
    )
    so_far = Window.partitionBy("conv").orderBy("block")
    blocks = (
        rows.groupBy("conv", "block")
        .agg(F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("n"))
        .select(
            "conv",
            "block",
            (F.sum("sum").over(so_far) - F.col("sum")).alias("sum_before"),
            (F.sum("n").over(so_far) - F.col("n")).alias("n_before"),
        )
    )
    inside = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_last("turn"), "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .withColumn("at", F.sum("tokens").over(upto) - F.col("tokens"))
        .join(blocks, ["conv", "block"])
        .withColumn("place", (F.col("place") + F.col("n_before")).cast("long"))
        .withColumn("at", F.col("at") + F.col("sum_before"))
        .drop("block", "n_before", "sum_before", "turn")
    )


def _render(segment: Column) -> Column:
    return F.concat(
        F.lit(START), segment["role"], F.lit(SEPARATOR), segment["text"], F.lit(END)
    )


def _loss(segments: Column) -> Column:
    """Places of the target texts in the rendered window: array<struct<start, end>>."""
    marks = len(START) + len(SEPARATOR)

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + marks + F.length(s["role"])
        end = start + F.length(s["text"])
        target = s["own"] & (s["role"] == ASSISTANT)
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(target, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(segments, begin, step, lambda state: state["spans"])


def format_windows(
    turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """Training windows of the conversations in ``turns`` (conv_id, turn, role, text).

    Returns ``conv_id``, ``window`` (tokens before its own turns; windows of a conversation
    sort by it), ``formatted``, ``repeated`` (how many of its first turns are repeats) and
    ``loss`` (code-point spans of the targets in ``formatted``).

    Turns go by number, null last; turns of one number by role and text. A first turn of role
    ``system`` is repeated in every later window and counts against the budget; if it takes more
    than three quarters of that, it is a window of its own and not repeated. Null roles
    and texts are empty. A null conv_id is a conversation of its own. Repeated rows are
    repeated turns. An empty table gives no windows. Roles and texts may hold anything: their
    control strings are escaped, and ``read_windows`` gives them back unchanged.

    No conversation is gathered: a window, repeats included, holds at most ``budget`` tokens,
    or a single turn that is larger.
    """
    if not 0 < history <= budget // 4:
        raise ValueError("history must be between 1 and a quarter of the budget")
    placed = staged(_placed_turns(turns), "placed")
    opening = F.col("place") == 0
    systems = placed.where(opening & (F.col("role") == SYSTEM)).select(
        "conv", F.col("text").alias("system_text"), F.col("tokens").alias("system_tokens")
    )
    system_tokens = F.coalesce("system_tokens", F.lit(0))
    # Turns have a quarter of the budget at least; what the system turn leaves is history's.
    retained = system_tokens <= budget - budget // 4
    spare = F.least(F.lit(history), budget - budget // 4 - system_tokens)
    at = F.col("at") - system_tokens
    ruled = (
        placed.join(staged(systems, "systems"), "conv", "left")
        .withColumn("is_system", opening & (F.col("role") == SYSTEM))
        .withColumn("retained", retained)
        .withColumn("history", F.when(F.col("retained"), spare).otherwise(F.lit(history)))
        .withColumn(
            "capacity", budget - F.col("history") - F.when(F.col("retained"), system_tokens).otherwise(0)
        )
        .withColumn("at", F.when(F.col("is_system"), F.lit(-1)).otherwise(at))
        .withColumn(
            "cell",
            F.when(F.col("is_system") & ~F.col("retained"), F.lit(-1)).otherwise(
                F.floor(F.greatest("at", F.lit(0)) / F.col("capacity"))
            ),
        )
        .withColumn(
            "crosses",
            ~F.col("is_system") & (F.floor((F.col("at") + F.col("tokens") - 1) / F.col("capacity")) > F.col("cell")),
        )
    )
    ruled = staged(ruled, "ruled")
    whole = (
        ruled.where(~F.col("is_system"))
        .groupBy("conv", "cell")
        .agg((F.sum("tokens") <= F.max("capacity")).alias("fits"))
    )
    assigned = staged(
        ruled.join(staged(whole, "cells"), ["conv", "cell"], "left").withColumn(
            "apart", F.col("crosses") & ~F.coalesce("fits", F.lit(True))
        ),
        "assigned",
    )
    segment = F.struct(
        "place", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text")
    )
    own = assigned.groupBy("conv", "cell", "apart").agg(
        F.first("conv_id").alias("conv_id"),
        F.min("at").alias("window"),
        F.first("system_text").alias("system_text"),
        F.first("system_tokens").alias("system_tokens"),
        F.first("retained").alias("retained"),
        F.first("history").alias("history"),
        F.sum("tokens").alias("own_tokens"),
        F.max("is_system").alias("opens"),
        F.sort_array(F.collect_list(segment)).alias("own"),
    )
    with_system = (
        F.col("system_text").isNotNull()
        & F.col("retained")
        & ~F.col("opens")
        & (F.col("own_tokens") + F.col("system_tokens") <= budget)
    )
    left = budget - F.col("own_tokens") - F.when(F.col("with_system"), F.col("system_tokens")).otherwise(0)
    own = staged(
        own.withColumn("with_system", with_system).withColumn("reach", F.least("history", left)), "own-turns"
    )
    # A window looks back at most ``history`` tokens: two stretches of that length.
    stretch = F.floor(F.greatest("window", F.lit(0)) / F.lit(history))
    looking = own.where("window > 0 AND reach > 0").select(
        "conv", "cell", "apart", "window", "reach", F.explode(F.array(stretch - 1, stretch)).alias("stretch")
    )
    earlier = assigned.where(~F.col("is_system")).select(
        "conv", segment.alias("segment"), "at", "tokens", F.floor(F.col("at") / history).alias("stretch")
    )
    before = (
        looking.join(earlier, ["conv", "stretch"])
        .where((F.col("at") >= F.col("window") - F.col("reach")) & (F.col("at") + F.col("tokens") <= F.col("window")))
        .groupBy("conv", "cell", "apart")
        .agg(F.sort_array(F.collect_list("segment")).alias("before"))
    )
    none = F.array().cast("array<struct<place:bigint,role:string,text:string>>")
    system = F.when(
        F.col("with_system"),
        F.array(
            F.struct(
                F.lit(0).cast("long").alias("place"),
                F.lit(SYSTEM).alias("role"),
                escape(F.col("system_text")).alias("text"),
            )
        ),
    ).otherwise(none)

    def marked(segments: Column, is_own: bool) -> Column:
        return F.transform(
            segments,
            lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"), F.lit(is_own).alias("own")),
        )

    return (
        own.join(staged(before, "before"), ["conv", "cell", "apart"], "left")
        .withColumn("head", F.concat(system, F.coalesce("before", none)))
        .withColumn("segments", F.concat(marked(F.col("head"), False), marked(F.col("own"), True)))
        .select(
            "conv_id",
            "conv",
            "window",
            F.array_join(F.transform("segments", _render), "").alias("formatted"),
            F.size("head").alias("repeated"),
            _loss(F.col("segments")).alias("loss"),
        )
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Add to formatted windows their own ``turns`` (role, text) and ``targets``, unescaped.

    Only the formatted text, the number of repeats and the loss spans are read.
    """
    pattern = (
        r"(?s)<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>"
    )
    found = F.arrays_zip(
        F.regexp_extract_all("formatted", F.lit(pattern), F.lit(1)).alias("role"),
        F.regexp_extract_all("formatted", F.lit(pattern), F.lit(2)).alias("text"),
    )
    own = F.slice(found, F.col("repeated") + 1, F.greatest(F.size(found) - F.col("repeated"), F.lit(0)))
    turns = F.transform(
        own, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))
    )
    targets = F.transform(
        "loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))
    )
    return windows.withColumn("turns", turns).withColumn("targets", targets)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows.

    A digest over a whole conversation needs its text in one row; this is the only step that
    gathers one, from windows that are already rendered.
    """
    lines = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    part = F.struct(
        "window", lines.alias("lines"), F.array_join("targets", "").alias("targets")
    )
    parts = F.sort_array(F.collect_list(part))
    return (
        read_windows(windows)
        .groupBy("conv")
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.sum(F.size("turns")).cast("long").alias("n_turns"),
            F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
            parts.alias("parts"),
        )
        .withColumn("all_turns", F.array_join(F.transform("parts", lambda p: p["lines"]), ""))
        .withColumn("all_loss", F.array_join(F.transform("parts", lambda p: p["targets"]), ""))
        .select(
            "conv_id",
            "n_turns",
            F.sha2("all_turns", 256).alias("turns_sha256"),
            F.length("all_loss").cast("long").alias("loss_chars"),
            F.sha2("all_loss", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
