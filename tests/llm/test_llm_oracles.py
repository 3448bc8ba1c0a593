"""The queries that SQL can express against their SQL, and the contract's registration."""

from __future__ import annotations

import random
import string
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from precinct.llm.queries import ORACLES, QUERIES
from test_chat import TURNS, long_systems


def test_one_query_per_operator_and_the_pipeline():
    names = list(contract.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(QUERIES) <= set(names) and set(ORACLES) <= set(contract.oracle_sql())


def assert_equals_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}{'/part-*.parquet' if file.is_dir() else ''}')")
    expected = duck.execute(ORACLES[name])
    columns = sorted(column[0] for column in expected.description)
    order = [[c[0] for c in expected.description].index(c) for c in columns]
    frame = QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == columns
    found = sorted(repr(tuple(row)) for row in frame.select(*columns).collect())
    assert found == sorted(repr(tuple(row[k] for k in order)) for row in expected.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert_equals_sql(spark, sf_dir, name)


def test_secrets_beside_others_match_the_sql(spark, tmp_path):
    rng = random.Random(10)
    letters = string.ascii_letters + string.digits
    key = lambda n, alphabet=letters + "+/_-": "".join(rng.choice(alphabet) for _ in range(n))
    texts = ["9f86d081884c7d65-Zk3vQ9xT1mB7rL5wN2pJ8dH4", "E3B0C44298FC1C149AFB-Zk3vQ9xT1mB7rL5wN2pJ8dH4"]
    texts += ["StringBuilderFactoryBean", "some/path/to/File_v12", "Ab" * 15, "file_v2-part-12/of", "A" * 25, "1-2" * 9]
    for _ in range(300):
        parts = [
            rng.choice([key(rng.randrange(10, 45)), key(rng.randrange(14, 45), "0123456789abcdef"), "x.y ",
                        "AKIA" + key(16, string.ascii_uppercase), "token=" + key(14), key(22, string.ascii_lowercase + "12"),
                        "internationalisation", "0123456789ABCDEF0123", " "])
            for _ in range(rng.randrange(1, 5))
        ]
        texts.append(rng.choice(["-", "/", " ", ""]).join(parts))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    assert_equals_sql(spark, str(tmp_path), "op10_secret_scans")


def test_long_system_turns_match_the_sql(spark, tmp_path):
    rows = long_systems(5) + [(900, 0, "system", "only"), (901, 0, "system", "s " * 500)]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert_equals_sql(spark, str(tmp_path), "op3_chat_formatting")


@pytest.mark.parametrize("name", ["op3_chat_formatting", "op5_url_filters", "op10_secret_scans", "op12_document_fingerprints"])
def test_native_queries_have_no_python_step(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
