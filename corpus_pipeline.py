"""Corpus pipeline: five stages, each over all that the one before kept.

Every stage is a function of (spark, docs, sf_dir); run() writes each result as Parquet
in the shared folder and reads it again for the next. All but the last return the
columns of documents, unchanged whatever their names.

Defined cases, of all stages: a null, empty or blank text has no words, so the first stage
rejects it, and the others, where they meet it, keep it (mixture: where its leaf's prefix
reaches it); very long texts are taken whole; repeated rows are judged alike, and
near_duplicates leaves one; a null doc_id is an id like others for all but the choice of a
survivor, where it comes last; ties go by doc_id, then by the hash of the text; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard, mixing, quality, sharding
from quarry.llm.rows import packed, unpacked
from quarry.session import drop_table, write_table


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one stays: the smallest doc_id (null last), of those the smallest text hash. Documents without shingles stay. Of rows with equal doc_id and text one stays, that of the smallest hash of the whole row."""
    d = packed(docs, "doc_id", own_th=F.xxhash64("text"))
    rows = jaccard.labelled_rows(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), ["doc_id", "th"])
    first = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("first"))
    stay = first.select("first.doc_id", "first.th").unionByName(rows.filter("label is null").select("doc_id", "th").distinct()).withColumnRenamed("doc_id", "stay")
    if not rows.groupBy("doc_id", "th").count().filter("count > 1").isEmpty():
        d = d.withColumn("whole", F.xxhash64(F.to_json("row")))
        least = write_table(d.groupBy(F.col("doc_id").alias("of_id"), F.col("own_th").alias("of_th")).agg(F.min("whole").alias("least")), "least")
        d = d.join(least.hint("shuffle_hash"), d["doc_id"].eqNullSafe(F.col("of_id")) & (F.col("own_th") == F.col("of_th")) & (F.col("whole") == F.col("least")), "left_semi")
        d = d.dropDuplicates(["doc_id", "own_th", "whole"])
    return d.join(stay.hint("shuffle_hash"), d["doc_id"].eqNullSafe(F.col("stay")) & (d["own_th"] == F.col("th")), "left_semi").transform(unpacked, docs.columns)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    hit = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0")
    hit = write_table(hit.select(F.col("doc_id").alias("hit_id"), "th").distinct(), "contaminated")
    d = packed(docs, "doc_id", own_th=F.xxhash64("text"))
    return d.join(hit.hint("shuffle_hash"), d["doc_id"].eqNullSafe(F.col("hit_id")) & (d["own_th"] == F.col("th")), "left_anti").transform(unpacked, docs.columns)


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; here at most once."""
    return unpacked(mixing.mix(packed(docs, "doc_id", "lang", "source", "text"), max_epochs=1).filter("copies > 0"), docs.columns)


def shards(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and virtual_slot of every document that is left."""
    return sharding.shard_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: hash functions and the greedy slot map have no equal in SQL; tests/llm holds run() against a brute-force version
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for no, (name, stage) in enumerate(STAGES[:-1]):
        docs = write_table(stage(spark, docs, sf_dir), name)
        if no:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
