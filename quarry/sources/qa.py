"""Question sets, example pools and gold texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_table

EXAMPLE = "struct<question:string,operations:array<struct<src_type:string,tgt_type:string,relation:string,anchor_name:string>>,final_operation:string,entity_name:string,entity_type:string,target_type:string,hop_count:int,operation_type:string,notes:string>"


def _field(line: Column, key: str) -> Column:
    return F.get_json_object(line, f"$.{key}")


def _names(line: Column, key: str) -> Column:
    """Names of an array of strings or of {name} objects."""
    return F.coalesce(F.transform(F.from_json(_field(line, key), "array<string>"), lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)), F.array().cast("array<string>"))


def read_qa(spark: SparkSession, path: str, entity_key: str, relation_keys: list[str], answers_key: str) -> DataFrame:
    """question, entity, gold_relations (empty ones dropped), gold_answers of a JSONL question set with its own key names."""
    d = spark.read.text(path).filter(F.trim("value") != "")
    line = F.col("value")
    rels = F.filter(F.array(*[_field(line, k) for k in relation_keys]), lambda r: r.isNotNull() & (r != ""))
    return d.select(F.coalesce(_field(line, "question"), F.lit("")).alias("question"), F.coalesce(_field(line, entity_key), F.lit("")).alias("entity"), rels.alias("gold_relations"), _names(line, answers_key).alias("gold_answers"))


def detect_sample_format(samples: DataFrame) -> DataFrame:
    """samples: idx, value (a JSON record). idx, query_type, entity_key, relations, answers by the keys that are there."""
    line, keys = F.col("value"), F.json_object_keys("value")
    has = lambda k: F.array_contains(keys, k)
    plain = has("answers") & ~has("answer_nodes")
    kind = F.when(plain, "one_hop").when(has("anchor_c_name"), "three_intersection").when(has("anchor_b_name"), "two_intersection").when(has("rel2"), "two_hop").otherwise("one_hop")
    three = [_field(line, f"anchor_{x}_rel") for x in "abc"]
    rels = F.when(kind == "three_intersection", F.array(*three)).when(kind == "two_intersection", F.array(*three[:2])).when(kind == "two_hop", F.array(_field(line, "rel1"), _field(line, "rel2"))).otherwise(F.array(_field(line, "relation")))
    entity = F.when(plain, "entity").when(kind.isin("three_intersection", "two_intersection"), "anchor_a_name").otherwise("anchor_name")
    return samples.select("idx", kind.alias("query_type"), entity.alias("entity_key"), F.filter(rels, lambda r: r.isNotNull() & (r != "")).alias("relations"), F.when(plain, _names(line, "answers")).otherwise(_names(line, "answer_nodes")).alias("answers"))


def read_examples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Example pools, each a JSON list or {examples: [..]}, with defaults filled in; a pool is a file, or a line."""
    d = spark.read.text(path, wholetext=not lines)
    pool = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{EXAMPLE}>")).otherwise(F.from_json("value", f"struct<examples:array<{EXAMPLE}>>")["examples"])
    e = d.select(F.explode(pool).alias("e")).select("e.*")
    fill = {"final_operation": "relate", "entity_name": "", "entity_type": "", "target_type": "", "hop_count": 1, "operation_type": "relate", "notes": ""}
    return e.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def read_pcqa_text(spark: SparkSession, path: str) -> DataFrame:
    """question, answer of a JSON array of records; the prefix `Output: ` of answers is taken off."""
    d = spark.read.schema("question string, answer string").json(path)
    return d.select("question", F.regexp_replace("answer", "^Output: ", "").alias("answer"))


def join_gold_by_original_index(samples: DataFrame, gold: DataFrame) -> DataFrame:
    """samples with original_index (from 1; null: 1); gold: pos (from 0), answer. Adds answer, '' where the index is out of range."""
    g = gold.select((F.col("pos") + 1).alias("_at"), "answer")
    d = samples.join(g.hint("merge"), F.coalesce("original_index", F.lit(1)) == F.col("_at"), "left").drop("_at")
    return d.withColumn("answer", F.coalesce("answer", F.lit("")))


def slice_dataset(rows: DataFrame, order: list[str], start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from `start` on in the given order, at most `limit`.

    A range sort numbers the rows of its partitions; where the partitions begin tells which rows to keep, so none is gathered for the rest.
    """
    at = F.monotonically_increasing_id()
    placed = write_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "placed")
    before, keep = 0, F.lit(False)
    for r in sorted(placed.groupBy("part").count().collect()):  # a row a partition
        first, last = start - before, (start + limit - before) if limit is not None else r["count"]
        if first < r["count"] and last > 0:
            keep = keep | ((F.col("part") == r["part"]) & (F.col("at") >= first) & (F.col("at") < last))
        before += r["count"]
    return placed.filter(keep).select("row.*").orderBy(*order)


def sample_dataset(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample of n rows, the same for the same key values; all rows when there are no more."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def load_by_index(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows with pos; wanted: request_no, pos. The rows asked for, in that order; positions that don't exist give nothing."""
    return wanted.join(rows, "pos").orderBy("request_no")
