"""Answer-set and text evaluation, failure analysis and aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: relation names that mean the same
ALIASES = {
    "associated_with": "associated_disease",
    "associated with": "associated_disease",
    "targeted_by": "target",
    "treated_by": "indication",
    "caused_by_drug": "side_effect",
    "interacted_by": "interacts_with",
    "expressed_gene": "expression_present",
    "expressed gene": "expression_present",
    "absent_gene": "expression_absent",
    "absent gene": "expression_absent",
}
#: fixed values: outcome categories
CATEGORIES = ["success", "error", "path_mismatch", "no_match", "partial_match", "over_prediction"]


def normalise_relation(rel: Column) -> Column:
    """Lower case, blanks and - as _, aliases resolved."""
    plain = F.translate(F.lower(rel), " -", "__")
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, plain), plain)


def folded(names: Column) -> Column:
    return F.array_distinct(F.transform(names, F.lower))


def set_metrics(outputs: DataFrame) -> DataFrame:
    """outputs: gold_answers, predicted_entities, error. Adds accuracy, recall, precision, f1 on case-folded sets; zeros for errors and empty gold."""
    gold, pred = folded(F.col("gold_answers")), folded(F.coalesce("predicted_entities", F.array().cast("array<string>")))
    both = F.size(F.array_intersect(gold, pred))
    live = F.col("error").isNull() & (F.size(gold) > 0)
    d = outputs.withColumns(
        {
            "accuracy": live & (both == F.size(gold)) & (F.size(gold) == F.size(pred)),
            "recall": F.when(live, both / F.size(gold)).otherwise(F.lit(0.0)),
            "precision": F.when(live & (F.size(pred) > 0), both / F.size(pred)).otherwise(F.lit(0.0)),
        }
    )
    total = F.col("precision") + F.col("recall")
    return d.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)))


def superset_metrics(outputs: DataFrame) -> DataFrame:
    """Case-sensitive variant: accurate if gold is contained in the prediction; with overlap counts."""
    gold, pred = F.array_distinct("gold_answers"), F.array_distinct("predicted_entities")
    return outputs.withColumns({"contains_gold": F.size(F.array_except(gold, pred)) == 0, "overlap": F.size(F.array_intersect(gold, pred)), "n_gold": F.size(gold), "n_pred": F.size(pred)})


def path_match(outputs: DataFrame) -> DataFrame:
    """Adds path_match: ordered equality of normalised relation lists, none of them empty; false for errors."""
    p, g = F.col("predicted_relations"), F.col("gold_relations")
    same = F.transform(p, normalise_relation) == F.transform(g, normalise_relation)
    return outputs.withColumn("path_match", F.coalesce(F.col("error").isNull() & (F.size(p) > 0) & (F.size(g) > 0) & same, F.lit(False)))


def classify(evals: DataFrame) -> DataFrame:
    """Adds category."""
    c = F.when(F.col("error").isNotNull(), "error").when(F.col("accuracy"), "success").when(F.col("recall") == 0, "no_match").when((F.col("recall") == 1) & (F.col("precision") < 1), "over_prediction")
    return evals.withColumn("category", c.otherwise("partial_match"))


def failure_summary(evals: DataFrame, by: list[str]) -> DataFrame:
    """Counts and percent of all categories per group; a path mismatch counts in addition to the row's own category."""
    c = classify(evals)
    wrong = c.filter(~F.col("path_match") & (F.size("predicted_relations") > 0) & (F.size("gold_relations") > 0) & (F.col("category") != "error"))
    n = c.unionByName(wrong.withColumn("category", F.lit("path_mismatch"))).groupBy(*by, "category").agg(F.count("*").alias("n"))
    total = evals.groupBy(*by).agg(F.count("*").alias("total"))
    every = total.select(*by, "total", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    d = every.join(n.hint("merge"), [*by, "category"], "left")
    return d.select(*by, "category", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total") * 100).alias("rate"))


def aggregate_metrics(evals: DataFrame, by: list[str]) -> DataFrame:
    """Totals, and means in percent over all rows, errors included."""
    pct = lambda c: (F.avg(F.col(c).cast("double")) * 100).alias(c)
    return evals.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count("error").alias("errors"),
        (F.count("*") - F.count("error")).alias("success"),
        *[pct(c) for c in ("accuracy", "recall", "precision", "f1")],
        (F.avg(F.col("path_match").cast("double")) * 100).alias("path_accuracy"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )


def repeat_stats(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation (0 for one run), min, max and n of each metric, rounded to 2."""
    d = runs.unpivot(by, metrics, "metric", "value").groupBy(*by, "metric")
    r = lambda c: F.round(c, 2)
    return d.agg(r(F.avg("value")).alias("mean"), r(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("std"), r(F.min("value")).alias("min"), r(F.max("value")).alias("max"), F.count("*").alias("n"))


def comparison_table(metrics: DataFrame, datasets: list[str], value: str = "accuracy") -> DataFrame:
    """pipeline, one column per dataset, and the unweighted average over datasets."""
    wide = metrics.groupBy("pipeline").pivot("dataset", datasets).agg(F.first(value))
    return wide.join(metrics.groupBy("pipeline").agg(F.avg(value).alias("average")), "pipeline")


def legacy_summary(evals: DataFrame, by: list[str], wall_ms: float) -> DataFrame:
    """Averages over rows without error only (0 without any), success rate, and parallel efficiency: their mean time x all rows / wall time."""
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c).cast("double"))), F.lit(0.0))
    ok = F.col("error").isNull()
    return evals.groupBy(*by).agg(
        F.count_if(ok).alias("n_ok"),
        (F.count_if(ok) / F.count("*")).alias("success_rate"),
        mean("accuracy").alias("full_hit_rate"),
        mean("recall").alias("avg_recall"),
        mean("precision").alias("avg_precision"),
        mean("f1").alias("avg_f1"),
        mean("latency_ms").alias("avg_time_ms"),
        (mean("latency_ms") * F.count("*") / wall_ms).alias("efficiency"),
    )


def splice_reruns(evals: DataFrame, reruns: DataFrame, key: str = "idx") -> DataFrame:
    """Errored rows give way to re-run rows of the same key. Raises if an errored row has no re-run."""
    errors = evals.filter(F.col("error").isNotNull())
    if not errors.join(reruns, key, "left_anti").isEmpty():
        raise ValueError("a row with an error has no re-run")
    return evals.join(errors.select(key), key, "left_anti").unionByName(reruns.join(errors.select(key), key, "left_semi"))


def timeout_rows(submitted: DataFrame, finished: DataFrame, limit_ms: float, key: str = "idx") -> DataFrame:
    """All submitted rows; those late or missing become error rows that keep their gold."""
    d = submitted.join(finished, key, "left")
    late = F.col("latency_ms").isNull() | (F.col("latency_ms") > limit_ms)
    return d.withColumns({"error": F.when(late, "timeout").otherwise(F.col("error")), "predicted_entities": F.when(late, F.array().cast("array<string>")).otherwise(F.col("predicted_entities")), "latency_ms": F.when(late, F.lit(limit_ms)).otherwise(F.col("latency_ms"))})


def outcome_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals by outcome, largest first."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def mean_set_accuracy(outputs: DataFrame) -> DataFrame:
    """Share of rows whose trimmed, case-folded sets agree."""
    norm = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x)))))
    return outputs.agg(F.avg((norm("gold_answers") == norm("predicted_entities")).cast("double")).alias("accuracy"))


def predicted_relations(paths: DataFrame) -> DataFrame:
    """paths: query_id, rank, rels. Relations of the first path of each query."""
    return paths.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter("_r = 1").select("query_id", "rels")


def aggregate_nl(evals: DataFrame, by: list[str]) -> DataFrame:
    """evals: rouge_l_r, rouge_l_p, rouge_l_f, similarity, latency_ms, error. Means in percent over all rows."""
    pct = lambda c, n: (F.avg(c) * 100).alias(n)
    return evals.groupBy(*by).agg(F.count("*").alias("total"), F.count("error").alias("errors"), pct("rouge_l_r", "rouge_l_recall"), pct("rouge_l_p", "rouge_l_precision"), pct("rouge_l_f", "rouge_l_f1"), pct("similarity", "embedding_similarity"), F.avg("latency_ms").alias("avg_latency_ms"))


def convert_stats(converted: DataFrame, rejects: DataFrame) -> DataFrame:
    """converted: type; rejects: reason. kind (converted, type or skipped), what, n."""
    total = converted.agg(F.count("*").alias("n")).select(F.lit("converted").alias("kind"), F.lit("all").alias("what"), "n")
    types = converted.groupBy(F.col("type").alias("what")).agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "what", "n")
    reasons = rejects.groupBy(F.col("reason").alias("what")).agg(F.count("*").alias("n")).select(F.lit("skipped").alias("kind"), "what", "n")
    return total.unionByName(types).unionByName(reasons)
