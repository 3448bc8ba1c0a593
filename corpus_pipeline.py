"""The corpus pipeline: from raw documents to the training mix, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's documents. All but the last return the columns they got.

1. language: the language network, trained on the documents themselves, drops texts without
   letters and texts whose best language is not probable enough: less than 2/15 of the way
   from chance to certainty, which is 0.35 for four languages. Where no document has a
   language there is nothing to learn from, and all texts with letters stay.
2. near duplicates: one document of each class of similar texts stays.
3. decontamination: documents with a benchmark passage by the contamination rule go.
4. secrets: secrets are replaced by a mark; every document stays.
5. mixing: sources are balanced to their target weights, and each document is repeated as
   often as the mix takes it, with its ``copy`` number; documents it does not take go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precinct.llm import decontaminate, language, mixing, near_duplicates, secrets
from precinct.llm.tables import staged, text_of

LEAST_CERTAINTY = 2 / 15


def least_score(languages: int) -> float:
    """The probability a text's best language must have, with so many to choose from."""
    chance = 1 / languages
    return chance + LEAST_CERTAINTY * (1 - chance) - 1e-6


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language.learn(docs)
    if net is None:
        return docs.where(text_of(docs).rlike(r"\p{L}"))
    judged = language.identify(docs, net, keep=docs.columns)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least_score(len(net.languages)))
    return judged.where(known).select("row.*")


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, benchmark, keep=docs.columns)
    return found.where(~decontaminate.is_contaminated()).select("row.*")


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, keep=docs.columns).where("copies > 0")
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    name = "copy"
    while name in docs.columns:
        name += "_"
    return mixed.select("row", number.alias(name)).select("row.*", name)


STAGES = [
    ("language identification", keep_known_languages),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", replace_secrets),
    ("mixing sources", mix_sources),
]

# SQL can express neither the trained network nor MinHash; tests hold every stage against a
# brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mix of the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
