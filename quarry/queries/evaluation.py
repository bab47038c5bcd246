"""Queries of evaluation and aggregation over outputs derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import table
from ..operators import evaluate as E
from . import registry

QUERIES, ORACLES, query = registry()

OUT_SQL = """
WITH c AS (SELECT o_custkey AS idx, n_name, r_name AS dataset, o_orderpriority AS seg, o_totalprice / 60 AS bal FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey),
outputs AS MATERIALIZED (
  SELECT idx, 'main' AS pipeline, dataset, coalesce(list_sort(list(DISTINCT seg) FILTER (bal > 5000)), []) AS gold, coalesce(list_sort(list(DISTINCT upper(seg) || CASE WHEN idx % 5 = 2 THEN ' ' ELSE '' END) FILTER (bal > 4000)), []) AS pred,
         CASE WHEN idx % 11 = 3 THEN 'failed' END AS error, 10.0 * idx AS latency_ms, ['LIVES_IN'] AS gold_rels, CASE WHEN idx % 2 = 0 THEN ['lives in'] ELSE ['based-in'] END AS pred_rels
  FROM c GROUP BY idx, dataset),
m AS MATERIALIZED (
  SELECT *, [lower(x) FOR x IN gold] AS g, [lower(x) FOR x IN pred] AS p, len(list_intersect([lower(x) FOR x IN gold], [lower(x) FOR x IN pred])) AS ov FROM outputs),
e0 AS (SELECT *, error IS NULL AND len(g) > 0 AS live FROM m),
e1 AS (SELECT *, live AND ov = len(g) AND len(g) = len(p) AS accuracy, CASE WHEN live THEN ov / len(g) ELSE 0 END AS recall, CASE WHEN live AND len(p) > 0 THEN ov / len(p) ELSE 0 END AS precision, error IS NULL AND idx % 2 = 0 AS path_match FROM e0),
evals AS MATERIALIZED (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM e1),
cats AS MATERIALIZED (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN accuracy THEN 'success' WHEN recall = 0 THEN 'no_match' WHEN recall = 1 AND precision < 1 THEN 'over_prediction' ELSE 'partial_match' END AS category FROM evals)
"""


def outputs(spark, d: str, least: float = 4000.0) -> DataFrame:
    """One row per customer: gold are the priorities of its larger orders, predicted those of a lower bound, in capitals and (for some) with a blank."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("bal", F.col("o_totalprice") / 60)
    c = o.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    idx = F.col("idx")
    seg = F.concat(F.upper("o_orderpriority"), F.when(F.col("o_custkey") % 5 == 2, " ").otherwise(""))
    g = c.groupBy(F.col("o_custkey").alias("idx"), F.col("r_name").alias("dataset")).agg(F.array_sort(F.collect_set(F.when(F.col("bal") > 5000, F.col("o_orderpriority")))).alias("gold_answers"), F.array_sort(F.collect_set(F.when(F.col("bal") > least, seg))).alias("predicted_entities"))
    return g.withColumns(
        {
            "pipeline": F.lit("main"),
            "error": F.when(idx % 11 == 3, "failed"),
            "latency_ms": idx * 10.0,
            "gold_relations": F.array(F.lit("LIVES_IN")),
            "predicted_relations": F.when(idx % 2 == 0, F.array(F.lit("lives in"))).otherwise(F.array(F.lit("based-in"))),
        }
    )


def evals(spark, d: str, least: float = 4000.0) -> DataFrame:
    return E.path_match(E.set_metrics(outputs(spark, d, least)))


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


@query(OUT_SQL + "SELECT idx, accuracy, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM evals")
def set_metrics(spark, d):
    return evals(spark, d).select("idx", "accuracy", *r6("recall", "precision", "f1"))


@query(OUT_SQL + "SELECT idx, len([x FOR x IN gold IF NOT list_contains(pred, x)]) = 0 AS contains_gold, len(list_intersect(gold, pred)) AS overlap, len(gold) AS n_gold, len(pred) AS n_pred FROM outputs")
def superset_metrics(spark, d):
    got = E.superset_metrics(outputs(spark, d)).select("idx", "contains_gold", "overlap", "n_gold", "n_pred")
    return got.withColumns({c: F.col(c).cast("long") for c in ("overlap", "n_gold", "n_pred")})


@query(OUT_SQL + "SELECT idx, path_match FROM evals")
def path_match(spark, d):
    return evals(spark, d).select("idx", "path_match")


@query(OUT_SQL + "SELECT idx, category FROM cats")
def classify(spark, d):
    return E.classify(evals(spark, d)).select("idx", "category")


@query(OUT_SQL + ", k AS (SELECT pipeline, category FROM cats UNION ALL SELECT pipeline, 'path_mismatch' FROM cats WHERE NOT path_match AND category <> 'error'), t AS (SELECT pipeline, count(*) AS total FROM evals GROUP BY 1) SELECT t.pipeline, x AS category, count(k.category) AS n, round(count(k.category) / any_value(total) * 100, 6) AS rate FROM t, (SELECT unnest(['success', 'error', 'path_mismatch', 'no_match', 'partial_match', 'over_prediction']) AS x) c LEFT JOIN k ON k.category = x AND k.pipeline = t.pipeline GROUP BY 1, 2")
def failure_summary(spark, d):
    return E.failure_summary(evals(spark, d), ["pipeline"]).select("pipeline", "category", "n", *r6("rate"))


@query(OUT_SQL + "SELECT pipeline, dataset, count(*) AS total, count(error) AS errors, count(*) - count(error) AS success, round(avg(accuracy::INT) * 100, 6) AS accuracy, round(avg(recall) * 100, 6) AS recall, round(avg(precision) * 100, 6) AS precision, round(avg(f1) * 100, 6) AS f1, round(avg(path_match::INT) * 100, 6) AS path_accuracy, round(avg(latency_ms), 6) AS avg_latency_ms FROM evals GROUP BY ALL")
def aggregate_metrics(spark, d):
    return E.aggregate_metrics(evals(spark, d), ["pipeline", "dataset"]).select("pipeline", "dataset", "total", "errors", "success", *r6("accuracy", "recall", "precision", "f1", "path_accuracy", "avg_latency_ms"))


RUNS = ", b AS (SELECT unnest([3000, 4000, 5000, 6000, 7000]) AS least), ro AS (SELECT least, idx, dataset, coalesce(list(DISTINCT lower(seg)) FILTER (bal > 5000), []) AS g, coalesce(list(DISTINCT lower(seg) || CASE WHEN idx % 5 = 2 THEN ' ' ELSE '' END) FILTER (bal > least), []) AS p FROM c, b GROUP BY ALL), rl AS (SELECT *, idx % 11 <> 3 AND len(g) > 0 AS live, len(list_intersect(g, p)) AS ov FROM ro), rm AS (SELECT least, dataset, CASE WHEN live THEN ov / len(g) ELSE 0 END AS recall, CASE WHEN live AND len(p) > 0 THEN ov / len(p) ELSE 0 END AS precision FROM rl), ra AS (SELECT least, dataset, avg(recall) * 100 AS recall, avg(precision) * 100 AS precision FROM rm GROUP BY ALL)"


@query(OUT_SQL + RUNS + " SELECT dataset, metric, round(avg(v), 2) AS mean, round(stddev_samp(v), 2) AS std, round(min(v), 2) AS min, round(max(v), 2) AS max, count(*) AS n FROM (SELECT dataset, 'recall' AS metric, recall AS v FROM ra UNION ALL SELECT dataset, 'precision', precision FROM ra) GROUP BY ALL")
def repeat_stats(spark, d):
    runs = None
    for least in (3000.0, 4000.0, 5000.0, 6000.0, 7000.0):
        one = E.aggregate_metrics(evals(spark, d, least), ["dataset"]).select("dataset", "recall", "precision").withColumn("least", F.lit(least))
        runs = one if runs is None else runs.unionByName(one)
    return E.repeat_stats(runs.drop("least"), ["dataset"], ["recall", "precision"])


@query(OUT_SQL + ", a AS (SELECT pipeline, dataset, avg(recall) * 100 AS recall FROM (SELECT * REPLACE ('late' AS pipeline) FROM evals WHERE idx % 3 = 0 UNION ALL SELECT * FROM evals) GROUP BY ALL) SELECT pipeline, " + ", ".join(f"round(max(recall) FILTER (dataset = '{x}'), 6) AS {x.lower().replace(' ', '_')}" for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + ", round(avg(recall), 6) AS average FROM a GROUP BY pipeline")
def comparison_table(spark, d):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    e = evals(spark, d)
    m = E.aggregate_metrics(e.unionByName(e.filter("idx % 3 = 0").withColumn("pipeline", F.lit("late"))), ["pipeline", "dataset"])
    t = E.comparison_table(m, names, "recall")
    return t.select("pipeline", *[F.round(F.col(f"`{n}`"), 6).alias(n.lower().replace(" ", "_")) for n in names], F.round("average", 6).alias("average"))


@query(OUT_SQL + "SELECT dataset, count(*) FILTER (error IS NULL) AS n_ok, round(count(*) FILTER (error IS NULL) / count(*), 6) AS success_rate, round(avg(accuracy::INT) FILTER (error IS NULL), 6) AS full_hit_rate, round(avg(recall) FILTER (error IS NULL), 6) AS avg_recall, round(avg(precision) FILTER (error IS NULL), 6) AS avg_precision, round(avg(f1) FILTER (error IS NULL), 6) AS avg_f1, round(avg(latency_ms) FILTER (error IS NULL), 6) AS avg_time_ms, round(avg(latency_ms) FILTER (error IS NULL) * count(*) / 1000, 6) AS efficiency FROM evals GROUP BY dataset")
def legacy_summary(spark, d):
    return E.legacy_summary(evals(spark, d), ["dataset"], 1000.0).select("dataset", "n_ok", *r6("success_rate", "full_hit_rate", "avg_recall", "avg_precision", "avg_f1", "avg_time_ms", "efficiency"))


@query(OUT_SQL + "SELECT idx, CASE WHEN error IS NULL THEN round(latency_ms, 6) ELSE 1.0 END AS latency_ms, NULL::VARCHAR AS error FROM outputs")
def splice_reruns(spark, d):
    o = outputs(spark, d)
    again = o.filter("error is not null").withColumns({"error": F.lit(None).cast("string"), "latency_ms": F.lit(1.0)})
    return E.splice_reruns(o, again).select("idx", F.round("latency_ms", 6).alias("latency_ms"), "error")


@query(OUT_SQL + "SELECT idx, CASE WHEN latency_ms > 150 OR idx % 7 = 2 THEN 'timeout' ELSE error END AS error, CASE WHEN idx % 7 = 2 THEN 150.0 ELSE least(latency_ms, 150.0) END AS latency_ms, len(gold) AS n_gold, CASE WHEN latency_ms > 150 OR idx % 7 = 2 THEN 0 ELSE len(pred) END AS n_pred FROM outputs")
def timeout_rows(spark, d):
    """Some rows are late, some never came back."""
    o = outputs(spark, d)
    got = E.timeout_rows(o.select("idx", "gold_answers"), o.filter("idx % 7 <> 2").drop("gold_answers", "dataset", "pipeline"), 150.0)
    return got.select("idx", "error", "latency_ms", F.size("gold_answers").cast("long").alias("n_gold"), F.size("predicted_entities").cast("long").alias("n_pred"))


@query(OUT_SQL + "SELECT dataset, category, count(*) AS n FROM cats GROUP BY ALL")
def outcome_stats(spark, d):
    return E.outcome_stats(E.classify(evals(spark, d)), ["dataset", "category"])


@query(OUT_SQL + "SELECT round(avg((list_sort([trim(x) FOR x IN g]) = list_sort([trim(x) FOR x IN p]))::INT), 6) AS accuracy FROM m")
def mean_set_accuracy(spark, d):
    return E.mean_set_accuracy(outputs(spark, d)).select(*r6("accuracy"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type")
def event_outcomes(spark, d):
    """Latency log by outcome."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))
