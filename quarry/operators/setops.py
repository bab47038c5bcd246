"""Set operations over the answers of several anchors, and property post-filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compare_text
from .hops import top_k


def combine_union(answers: DataFrame) -> DataFrame:
    """answers: query_id, anchor_no, path_id, name. Distinct names over all anchors and paths."""
    return answers.select("query_id", "name").distinct()


def combine_intersection(answers: DataFrame, anchors: DataFrame) -> DataFrame:
    """Union within an anchor, intersection across the query's anchors (an anchor without answers empties it)."""
    n = anchors.groupBy("query_id").agg(F.countDistinct("anchor_no").alias("n"))
    got = answers.groupBy("query_id", "name").agg(F.countDistinct("anchor_no").alias("m"))
    return got.join(n, "query_id").filter("m = n").select("query_id", "name")


def combine_exclude(answers: DataFrame) -> DataFrame:
    """The first anchor's names without those of the other anchors."""
    g = answers.groupBy("query_id", "name").agg(F.min("anchor_no").alias("lo"), F.max("anchor_no").alias("hi"))
    first = F.min("lo").over(Window.partitionBy("query_id"))
    return g.withColumn("first", first).filter("lo = first and hi = first").select("query_id", "name")


def lenient_intersection(answers: DataFrame, most: int = 50) -> DataFrame:
    """Intersection of the anchors that have answers at all, first names only."""
    n = answers.groupBy("query_id").agg(F.countDistinct("anchor_no").alias("n"))
    got = answers.groupBy("query_id", "name").agg(F.countDistinct("anchor_no").alias("m"))
    return top_k(got.join(n, "query_id").filter("m = n").select("query_id", "name"), ["query_id"], ["name"], most)


def property_filter(answers: DataFrame, filters: DataFrame, nodes: DataFrame) -> DataFrame:
    """filters: query_id, prop, op, value (all must hold; values compare as numbers, else as dates, else as text). Skipped for a query that it would empty."""
    props = nodes.select(F.lower("name").alias("low"), "props")
    met = answers.withColumn("low", F.lower("name")).join(props, "low").join(filters, "query_id").withColumn("v", F.try_element_at("props", "prop"))
    side = F.when(F.col("v").isNotNull(), compare_text(F.col("v"), F.col("value")))
    ok = F.when(F.col("op") == "=", side == 0).when(F.col("op") == "!=", side != 0).when(F.col("op") == "<", side < 0).when(F.col("op") == ">", side > 0).when(F.col("op") == "<=", side <= 0).when(F.col("op") == ">=", side >= 0)
    per = met.groupBy("query_id", "name", "prop", "op", "value").agg(F.bool_or(F.coalesce(ok, F.lit(False))).alias("ok")).groupBy("query_id", "name").agg(F.bool_and("ok").alias("ok"))
    d = answers.join(per, ["query_id", "name"], "left").join(filters.select("query_id").distinct().withColumn("asked", F.lit(True)), "query_id", "left")
    d = d.withColumn("stay", F.coalesce("ok", F.col("asked").isNull())).withColumn("any", F.bool_or("stay").over(Window.partitionBy("query_id")))
    return d.filter("stay or not any").select("query_id", "name")
