"""Bucketed ranks, totals and neighbours against the plain window on skewed groups."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.functions.keys import order_digest
from labelloom.operators.ordering import BUCKET, neighbour, order_buckets, position_rank, running_totals, seeded_rank, seeded_take


@pytest.fixture(scope="module")
def skewed(spark):
    """900 of 1,200 rows in one group, one null group, repeated order values."""
    g = F.when(F.col("id") < 900, "hot").when(F.col("id") < 1100, F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    t = F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.hash("id"), F.lit(500)).cast("double"))
    return spark.range(1200).select("id", g.alias("g"), t.alias("t"), (F.col("id") % 11).alias("x"))


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_seeded_rank(skewed):
    got = seeded_rank(skewed, ["g"], "id", 42).select("id", "g", "rank", "rank_total")
    order = W.partitionBy("g").orderBy(order_digest("id", 42), "id")
    want = skewed.select("id", "g", F.row_number().over(order).cast("bigint").alias("rank"),
                         F.count("*").over(W.partitionBy("g")).alias("rank_total"))
    same(got, want)


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("share", [0.0, 0.3, 0.77, 1.0])
def test_seeded_take(skewed, by, share):
    got = seeded_take(skewed, by, "id", 42, lambda total: F.round(total * share), digits=2).where("taken").select("id", "g", "t", "x")
    order = W.partitionBy(*by).orderBy(order_digest("id", 42), "id")
    ranked = skewed.withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy(*by)))
    same(got, ranked.where(F.col("r") <= F.round(F.col("n") * share)).drop("r", "n"))


def test_position_rank_with_ties(skewed):
    got = position_rank(skewed, ["g"], "t", ["id"], "r").select("id", "r")
    want = skewed.select("id", F.row_number().over(W.partitionBy("g").orderBy("t", "id")).cast("bigint").alias("r"))
    same(got, want)


def test_running_totals(skewed):
    rows = order_buckets(skewed, "t", 16)
    got = running_totals(rows, ["g"], [F.col("t"), F.col("id")], {"s": F.col("x")}).select("id", "s")
    frame = W.partitionBy("g").orderBy("t", "id").rowsBetween(W.unboundedPreceding, 0)
    same(got, skewed.select("id", F.sum("x").over(frame).alias("s")))


@pytest.mark.parametrize("previous", [True, False])
def test_neighbour(skewed, previous):
    rows = order_buckets(skewed, "t", 16)
    got = neighbour(rows, ["g"], ["t", "id"], {"other": F.col("id"), "ox": F.col("x")}, previous).select("id", "other", "ox")
    order = W.partitionBy("g").orderBy("t", "id")
    pick = F.lag if previous else F.lead
    same(got, skewed.select("id", pick("id").over(order).alias("other"), pick("x").over(order).alias("ox")))


def test_one_bucket_and_empty(spark, skewed):
    one = position_rank(skewed.withColumn("t", F.lit(1.0)), ["g"], "t", ["id"], "r")
    assert one.agg(F.max("r")).first()[0] == 900
    assert position_rank(skewed.where("id < 0"), ["g"], "t", ["id"], "r").count() == 0
