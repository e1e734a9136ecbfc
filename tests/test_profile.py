"""Inspection, profiles, duplicates and snapshots."""

import pytest
from pyspark.sql import functions as F

from auditframe.functions.identity import content_fingerprint, schema_fingerprint
from auditframe.operators.profile import (
    candidate_keys, category_snapshot, duplicate_rows, inspect_columns, inspect_dataset, profile_categorical, profile_numeric,
    uniqueness_violations,
)


@pytest.fixture()
def records(spark):
    return spark.createDataFrame(
        [(1, "alpha", 10.0), (2, "beta", 20.0), (2, "beta", 20.0), (4, None, float("nan"))], "id long, category string, amount double"
    )


def test_inspect(records):
    assert [(r["column_name"], r["missing_count"], r["missing_percentage"]) for r in inspect_columns(records).orderBy("position").collect()] == [
        ("id", 0, 0.0), ("category", 1, 25.0), ("amount", 1, 25.0)
    ]
    assert tuple(inspect_dataset(records).first()) == (4, 3, 1)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a long, b string")
    assert [r["missing_percentage"] for r in inspect_columns(empty).collect()] == [0.0, 0.0]
    assert tuple(duplicate_rows(empty).first()) == (0, 0)
    assert not any(r["is_candidate_key"] for r in candidate_keys(empty).collect())


def test_profiles(records):
    numeric = {r["column_name"]: r for r in profile_numeric(records).collect()}
    assert numeric["amount"]["median"] == 20 and numeric["amount"]["missing_count"] == 1 and numeric["id"]["maximum"] == 4
    top = profile_categorical(records).orderBy("rank").collect()
    assert [(r["value"], r["frequency"]) for r in top] == [("beta", 2), ("alpha", 1)]
    assert top[0]["unique_count"] == 2 and top[0]["missing_count"] == 1


def test_duplicates_count_missing_values_as_equal(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, None), (1, 2.0)], "a long, b double")
    assert duplicate_rows(df).first()["duplicate_row_count"] == 1
    assert uniqueness_violations(df, "a").first()["violating_rows"] == 2


def test_candidate_keys(records):
    keys = {r["column_name"]: r["is_candidate_key"] for r in candidate_keys(records.withColumn("n", F.monotonically_increasing_id())).collect()}
    assert keys == {"id": False, "category": False, "amount": False, "n": True}


def test_snapshot_lists_small_sets_only(spark):
    df = spark.range(300).select(
        F.concat(F.lit("v"), F.col("id") % 101).alias("many"), F.concat(F.lit("v"), F.col("id") % 100).alias("fits"),
        F.when(F.col("id") == 0, F.lit("x" * 201)).otherwise("y").alias("long"), F.lit(None).cast("string").alias("none"), "id",
    )
    found = {r["column_name"]: r for r in category_snapshot(df).collect()}
    assert (found["many"]["unique_count"], found["many"]["values_complete"], found["many"]["category_values"]) == (101, False, [])
    assert found["fits"]["values_complete"] and len(found["fits"]["category_values"]) == 100
    assert not found["long"]["values_complete"] and "id" not in found
    assert found["none"]["unique_count"] == 0 and found["none"]["values_complete"]


def test_fingerprints(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x long, y string")
    same = df.orderBy(F.col("x").desc()).repartition(3)
    other = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "x long, y string")
    fewer = df.distinct()
    prints = [content_fingerprint(d).first()["fingerprint"] for d in (df, same, other, fewer)]
    assert prints[0] == prints[1] and len(set(prints)) == 3
    assert schema_fingerprint(df) == schema_fingerprint(other) != schema_fingerprint(df.select("y", "x"))
