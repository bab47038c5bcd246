"""Building and mending question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_decoded
from .explore import pattern_answers, pattern_queries
from .lookup import find_seed

#: fixed values: relation names; an answer that is one of them makes a relation question
KNOWN_RELATIONS = [
    "associated with", "expression present", "expression absent",
    "phenotype present", "phenotype absent", "target", "indication",
    "contraindication", "off label use", "side effect", "carrier",
    "enzyme", "transporter", "ppi", "interacts with", "linked to",
    "parent child", "synergistic interaction", "linked exposure",
    "absent gene", "expressed gene",
]


def convert_triples(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """records: idx, question, answers (array), triples (array of [source, relation, target]), type.

    (converted, rejects): converted has idx, question (without brackets and URLs), anchor,
    answers, relations (in order; one is left out if its lower-cased name is there already),
    type; rejects have idx and reason (no_question, no_answer, relation_answer).
    """
    answers = F.filter(F.transform(F.filter("answers", lambda a: a.isNotNull()), lambda a: F.trim(F.regexp_replace(percent_decoded(a), ">+$", ""))), lambda a: a != "")
    first = F.regexp_replace(F.get(F.get("triples", F.lit(0)), F.lit(0)), r"^[\[\]]+|[\[\]]+$", "")
    tail = lambda x, at: F.element_at(F.split(x, at), -1)
    closed = lambda x: F.regexp_replace(x, ">+$", "")
    # a name under node/ stays as it is, one under vocab/ is decoded
    anchor = F.when(first.contains("/vocab/"), percent_decoded(closed(tail(first, "/vocab/")))).when(first.contains("/node/"), closed(tail(first, "/node/"))).otherwise(first)
    anchor = F.regexp_replace(anchor, "^[<>]+|[<>]+$", "")
    rel = F.transform("triples", lambda t: F.trim(percent_decoded(tail(F.regexp_replace(F.get(t, F.lit(1)), r"^[\[\]<>]+|[\[\]<>]+$", ""), "/vocab/"))))
    d = records.select("idx", F.trim(F.coalesce("question", F.lit(""))).alias("q"), answers.alias("answers"), anchor.alias("anchor"), rel.alias("rels"), "type")
    reason = F.when(F.col("q") == "", "no_question").when(F.coalesce(F.size("answers"), F.lit(0)) <= 0, "no_answer").when(F.exists("answers", lambda a: F.lower(a).isin(KNOWN_RELATIONS)), "relation_answer")
    d = d.withColumn("reason", reason)
    once = F.aggregate("rels", F.array().cast("array<string>"), lambda acc, r: F.when((r == "") | F.array_contains(acc, F.lower(r)), acc).otherwise(F.array_append(acc, r)))
    question = F.trim(F.regexp_replace(F.regexp_replace("q", r"\[([^\]]+)\]", "$1"), "<https?://[^>]+>", ""))
    return d.filter("reason is null").select("idx", question.alias("question"), "anchor", "answers", once.alias("relations"), "type"), d.filter("reason is not null").select("idx", "reason")


def build_gold(questions: DataFrame, classes: DataFrame, patterns: DataFrame, nodes: DataFrame, edges: DataFrame, suffixes: list[str], words: str) -> tuple[DataFrame, DataFrame]:
    """questions: query_id, question; classes: query_id, pattern, seed. (gold, outcomes).

    gold: query_id, question, pattern, seed (the name that the seed resolves to), answers;
    outcomes: query_id, outcome (ok, no_seed, no_answer). The pattern starts from the seed
    as given.
    """
    c = questions.join(classes.hint("merge"), "query_id")
    seeds = find_seed(c.select("query_id", F.col("seed").alias("anchor")), nodes, suffixes, words).select("query_id", F.col("name").alias("resolved"))
    got = pattern_answers(pattern_queries(c.select("query_id", "pattern", "seed"), patterns, nodes, edges)).groupBy("query_id").agg(F.array_sort(F.collect_list("name")).alias("answers"))
    d = c.join(seeds.hint("merge"), "query_id", "left").join(got.hint("merge"), "query_id", "left")
    outcome = F.when(F.col("resolved").isNull(), "no_seed").when(F.col("answers").isNull(), "no_answer").otherwise("ok")
    return d.filter(outcome == "ok").select("query_id", "question", "pattern", F.col("resolved").alias("seed"), "answers"), d.select("query_id", outcome.alias("outcome"))


def apply_manual_fixes(samples: DataFrame, fixes: DataFrame) -> DataFrame:
    """samples: idx, entities; fixes: idx, entities, skip, uncertain. Entities replaced, skipped samples left out; adds uncertain."""
    f = fixes.select("idx", F.col("entities").alias("_fixed"), "skip", F.coalesce("uncertain", F.lit(False)).alias("uncertain"))
    d = samples.join(f.hint("merge"), "idx", "left").filter(~F.coalesce("skip", F.lit(False)))
    return d.select(*[c for c in samples.columns if c != "entities"], F.coalesce("_fixed", "entities").alias("entities"), F.coalesce("uncertain", F.lit(False)).alias("uncertain"))


def category_split(samples: DataFrame, categories: DataFrame, keep: list[str]) -> DataFrame:
    """samples: idx; categories: category, indexes (array). Samples that are in one of the kept categories."""
    idx = categories.filter(F.col("category").isin(keep)).select(F.explode("indexes").alias("idx")).distinct()
    return samples.join(idx.hint("merge"), "idx", "left_semi")


def prompt_rows(selected: DataFrame, examples: DataFrame) -> DataFrame:
    """selected: query_id, rank, name (of an example); examples: name, question, operations, notes. query_id, text (numbered examples as JSON), notes (each once, in order)."""
    d = selected.join(examples.hint("merge"), "name")
    line = F.concat(F.lit("Example "), F.col("rank").cast("string"), F.lit(": "), "question", F.lit("\n"), F.to_json("operations"))
    g = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "notes"))).alias("x"))
    notes = F.array_distinct(F.filter(F.transform("x", lambda e: e["notes"]), lambda n: n != ""))
    return g.select("query_id", F.array_join(F.transform("x", lambda e: e["line"]), "\n\n").alias("text"), F.array_join(notes, "\n").alias("notes"))
