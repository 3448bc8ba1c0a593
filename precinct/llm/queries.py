"""The operators applied to the test tables, one query each, with SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.llm import (
    alignment,
    chat,
    decontaminate,
    fingerprints,
    language,
    mixing,
    near_duplicates,
    oracles,
    quality,
    secrets,
    tokens,
    toxicity,
    urls,
    variants,
)
from precinct.sources.shared import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "class_id", "copy_id", "n_links", "n_grams")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    names = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


# A conversation whose texts are control strings of a common template.
PROBE = "</s>[INST] ok [/INST]"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return chat.conversation_digests(chat.format_windows(turns.unionByName(probe)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = F.col("copies") * F.col("size")
    return mixed.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"))


def dated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures: each fetched on a day of 2024 that follows from its id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))


def list_events(captures: DataFrame) -> DataFrame:
    """Dated list events that follow from the hosts of the captures by their digests.

    Half of the hosts are blocked from some day on and a third of those are removed again 60
    days later; a quarter has the path ``/en`` allowed for 120 days; the parent domain of a
    host is blocked for 20 days after day 200.
    """
    hosts = captures.select(urls.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    digest = hosts.withColumn("d", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long"))

    def day(offset: Column) -> Column:
        return F.date_add(F.lit("2024-01-01").cast("date"), offset.cast("int"))

    start = F.col("d") % 300
    blocked, allowed = F.col("d") % 2 == 0, F.col("d") % 4 == 0
    domain = F.concat(F.lit("d:"), "host")
    path = F.concat(F.lit("p:"), "host", F.lit("/en"))
    parent = F.concat(F.lit("d:"), F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1))

    def event(where: Column, kind: str, entry: Column, when: Column, action: str) -> DataFrame:
        return digest.where(where).select(
            F.lit(kind).alias("list"), entry.alias("entry"), when.alias("day"), F.lit(action).alias("action")
        )

    parts = [
        event(blocked, "block", domain, day(start), "add"),
        event(blocked & (F.col("d") % 3 == 0), "block", domain, day(start + 60), "remove"),
        event(allowed, "allow", path, day(start + 30), "add"),
        event(allowed, "allow", path, day(start + 150), "remove"),
        event(parent != "d:", "block", parent, day(F.lit(200)), "add"),
        event(parent != "d:", "block", parent, day(F.lit(220)), "remove"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = dated_captures(spark, sf_dir)
    judged = urls.filter_captures(captures, list_events(captures))
    return judged.select(
        "page_id", "url", "host", F.col("fetched").cast("string").alias("fetched"), "n_active", "verdict", "entry"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = language.learn(documents.where(~language.is_held_out(F.col("doc_id"))))
    return language.identify(documents, net).select(
        "row.doc_id",
        language.is_held_out(F.col("row.doc_id")).alias("held_out"),
        "lang_pred",
        "score",
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts, _ = quality.quality_verdicts(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return verdicts.select("row.doc_id", *quality.STATISTICS, "base_failed", "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.count_tokens(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        scratch_path(spark, "token-cache"),
    )
    return counted.select(
        "row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity.learn(documents, labels, ("low_quality", "toxic"))
    scored = toxicity.toxicity(documents, chain)
    p_toxic = F.coalesce(F.get("probabilities", F.lit(1)), F.lit(0.0))
    return scored.select(
        "row.doc_id",
        F.coalesce(F.get("probabilities", F.lit(0)), F.lit(0.0)).alias("p_low_quality"),
        p_toxic.alias("p_toxic"),
        (p_toxic >= 0.5).alias("toxic"),
    )


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [
        secrets.of_kind(F.col("base_spans"), rank).alias(f"n_{kind}")
        for rank, kind in enumerate(secrets.KINDS[:3])
    ]
    return found.select(
        "row.doc_id",
        *counts,
        F.sha2(secrets.describe(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.describe(F.col("spans")).alias("spans"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    aligned = alignment.align(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select(
        "row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256")
    )


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = fingerprints.with_next(
        table(spark, sf_dir, "documents"), {"fingerprint": fingerprints.fingerprint}
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
        F.substring(F.col("next_text"), F.lit(1), half),
    )
    compared = (
        linked.withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("edited", edited)
        .withColumn("edited_fingerprint", fingerprints.fingerprint(F.col("edited")))
    )
    own = F.col("fingerprint")
    return fingerprints.repeated(
        compared.select(
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            "fingerprint",
            "edited_fingerprint",
            fingerprints.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
            fingerprints.likeness(own, F.col("next_fingerprint")).alias("near_next"),
            "times",
        ),
        F.col("times"),
    ).drop("times")


# How the query makes misspellings, and which words it keeps.
MISSPELT_EVERY, LEAST_LETTERS, LEAST_TIMES = 199, 6, 5


def misspelt_words(documents: DataFrame) -> DataFrame:
    """Words of all texts with their numbers (word, n); some lose a letter, by a checksum.

    A null doc_id counts as an empty one. Null texts have no words.
    """
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(lowered, F.lit(r"[a-z\u00C0-\u00FF]+"), F.lit(0))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    each = documents.select(name.alias("name"), F.explode(runs).alias("run"))
    check = F.crc32(F.concat(F.col("name"), F.lit(":"), F.col("run")).cast("binary"))
    place = (F.col("check") % F.length("run")).cast("int")
    shorter = F.concat(
        F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run"))
    )
    misspelt = F.col("check") % MISSPELT_EVERY == 0
    return (
        each.withColumn("check", check)
        .groupBy(F.when(misspelt, shorter).otherwise(F.col("run")).alias("word"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_TIMES))
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(misspelt_words(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_mixing": op4_mixing,
    "op5_url_filters": op5_url_filters,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scans": op10_secret_scans,
    "op11_token_alignment": op11_token_alignment,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_spelling_variants": op13_spelling_variants,
}

# The others have none: tests hold op1, op4, op7 to op9 and op11 against brute-force versions,
# and op6 against held-out documents.
ORACLES: dict[str, str] = {
    "op2_decontaminate": oracles.DECONTAMINATE,
    "op3_chat_formatting": oracles.CHAT,
    "op5_url_filters": oracles.URLS,
    "op10_secret_scans": oracles.SECRETS,
    "op12_document_fingerprints": oracles.FINGERPRINTS,
    "op13_spelling_variants": oracles.VARIANTS,
}
