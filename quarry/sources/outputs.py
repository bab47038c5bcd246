"""Run outputs, metric documents, failure details and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import classify


def write_outputs(outputs: DataFrame, path: str) -> None:
    """Run outputs as JSON lines, a folder for each pipeline and data set."""
    outputs.write.mode("overwrite").partitionBy("pipeline", "dataset").json(path)


def read_outputs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_metrics_summary(metrics: DataFrame, path: str) -> None:
    """One JSON record for each pipeline: its data sets with their metrics."""
    own = [c for c in metrics.columns if c not in ("pipeline", "dataset")]
    metrics.groupBy("pipeline").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", F.struct(*own))))).alias("datasets")).write.mode("overwrite").json(path)


def read_metrics_summary(spark: SparkSession, path: str, metrics: str) -> DataFrame:
    """pipeline, dataset and the metrics named by the schema text."""
    d = spark.read.schema(f"pipeline string, datasets map<string,struct<{metrics}>>").json(path)
    return d.select("pipeline", F.explode("datasets").alias("dataset", "m")).select("pipeline", "dataset", "m.*")


def write_failure_analysis(evals: DataFrame, path: str) -> None:
    """Rows that aren't successes, by category."""
    classify(evals).filter("category <> 'success'").write.mode("overwrite").partitionBy("category").json(path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """name, vec as Parquet."""
    vectors.select("name", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
