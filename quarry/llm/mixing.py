"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source). A budget of tokens goes down the tree by integer
weights. A node never gets more than its subtree can give (tokens x `max_epochs`); what
one child can't take is dealt to its siblings by their weights, and only what a whole
subtree can't take goes to the siblings of its parent. Each leaf then takes whole seeded
epochs and, below `max_epochs`, the token-prefix of one more: an epoch orders the leaf's documents by
md5(seed:epoch:doc_id), and documents are taken while the running total fits.

Running totals are kept per (leaf, 12 bits of the order key) first, so that only the
one bucket where a leaf's cut falls is ordered row by row; a hot source is spread over
4096 buckets. The table of leaves is broadcast up to MAX_BROADCAST_LEAVES rows; beyond,
it is joined by shuffle. Integer arithmetic throughout, so results are the same anywhere.

Defined cases: null lang or source are leaves of their own (''); null or blank texts have
0 tokens and are taken as soon as the prefix reaches them; a null doc_id orders as '';
rows with equal doc_ids in a leaf are ties, taken or left together; an empty table gives
no rows; very long texts count all their words; other columns come back unchanged, one
that bears the name of a result as own_<name>. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .quality import WORD_BREAK
from .rows import packed, unpacked

SEED = 17
SHARE_PERCENT = 60
MAX_EPOCHS = 2
MAX_BROADCAST_LEAVES = 100_000
LEAF = ["domain", "lang", "source"]


def domain_of(source):
    """Domain of a source: its trailing number, of any length, modulo 3, else 0. A number has the remainder of its digits' sum."""
    digits = F.regexp_extract(source, "([0-9]+)$", 1)
    ones, twos = F.char_length(F.translate(digits, "0235689", "")), F.char_length(F.translate(digits, "0134679", ""))
    return F.concat(F.lit("domain"), ((ones + 2 * twos) % 3).cast("string"))


def default_weight(level: str, name):
    """Target weights: domain0 counts 3, domain1 2, others 1; English counts 4, other languages 2; sources 1 each."""
    if level == "domain":
        return F.when(name == "domain0", 3).when(name == "domain1", 2).otherwise(1).cast("long")
    if level == "lang":
        return F.when(name == "en", 4).otherwise(2).cast("long")
    return F.lit(1).cast("long")


def with_leaf(docs: DataFrame) -> DataFrame:
    """Adds domain, tokens and the leaf keys leaf_lang and leaf_source (null: '')."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.withColumns({"leaf_lang": F.coalesce(F.col("lang"), F.lit("")), "leaf_source": source, "leaf_domain": domain_of(source)})


def n_tokens(text):
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")).cast("long")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Deal parent's `budget` among its children: nodes has parent keys, name, cap, weight, budget (the parent's); returns the child's own budget.

    Children in order of cap / weight: with the first ones full, the rest share by weight;
    the first child that its share doesn't fill marks the level.
    """
    order = [F.col("cap") / F.col("weight"), F.col(name)]
    w = Window.partitionBy(*parent).orderBy(*order)
    before = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    d = nodes.withColumns({"left_over": F.col("budget") - before, "rest": rest})
    d = d.withColumn("open", F.col("left_over") * F.col("weight") <= F.col("cap") * F.col("rest"))
    mark = lambda c: F.first(F.when(F.col("open"), F.col(c)), True).over(Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = d.withColumns({"level_left": mark("left_over"), "level_rest": mark("rest"), "seen_open": F.max(F.col("open")).over(w)})
    got = F.when(~F.col("seen_open") | F.col("level_rest").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.expr("(level_left * weight) div level_rest")))
    return d.withColumn("budget", got.cast("long")).drop("left_over", "rest", "open", "level_left", "level_rest", "seen_open")


def leaf_budgets(leaves: DataFrame, share_percent: int, max_epochs: int, weight=default_weight) -> DataFrame:
    """leaves: domain, lang, source, tokens; adds cap and budget."""
    l = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = l.agg(F.expr(f"(sum(tokens) * {share_percent}) div 100").alias("budget"))
    dom = l.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", weight("domain", F.col("domain"))).withColumn("root", F.lit(0))
    dom = fill(dom.join(F.broadcast(total.withColumn("root", F.lit(0))), "root"), ["root"], "domain").select("domain", "budget")
    lang = l.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", weight("lang", F.col("lang")))
    lang = fill(lang.join(dom.hint("merge"), "domain"), ["domain"], "lang").select("domain", "lang", "budget")
    src = l.withColumn("weight", weight("source", F.col("source")))
    return fill(src.join(lang.hint("merge"), ["domain", "lang"]), ["domain", "lang"], "source").select(*LEAF, "tokens", "cap", "budget")


def plan(docs: DataFrame, seed: int, share_percent: int, max_epochs: int, weight=default_weight) -> DataFrame:
    """Per leaf: tokens, budget, full (whole epochs), and the last order key taken in the epoch after (null: none)."""
    d = with_leaf(docs).select(F.col("leaf_domain").alias("domain"), F.col("leaf_lang").alias("lang"), F.col("leaf_source").alias("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), n_tokens(F.col("text")).alias("tokens"))
    d = write_table(d, "tokens")
    leaves = d.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    budgets = write_table(leaf_budgets(leaves, share_percent, max_epochs, weight).withColumns({"full": F.expr("if(tokens = 0, 0, budget div tokens)"), "part": F.expr(f"case when tokens = 0 then 0 when budget div tokens < {max_epochs} then budget % tokens else -1 end")}), "budgets")
    keyed = d.join(small(budgets.select(*LEAF, "full", "part")), LEAF).withColumn("key", order_key(seed, F.col("full"), F.col("name"))).withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEAF, "bucket").agg(F.sum("tokens").alias("in_bucket"), F.first("part").alias("part"))
    ahead = F.sum("in_bucket").over(Window.partitionBy(*LEAF).orderBy("bucket")) - F.col("in_bucket")
    sums = write_table(sums.withColumn("ahead", ahead), "buckets")
    cut = sums.filter((F.col("ahead") <= F.col("part")) & (F.col("ahead") + F.col("in_bucket") > F.col("part"))).select(*LEAF, "bucket", "ahead")
    # rows of one doc_id share a key and are taken together
    inside = keyed.groupBy(*LEAF, "bucket", "key").agg(F.sum("tokens").alias("tokens"), F.first("part").alias("part")).join(cut.hint("merge"), [*LEAF, "bucket"])
    run = F.col("ahead") + F.sum("tokens").over(Window.partitionBy(*LEAF, "bucket").orderBy("key"))
    last = inside.withColumn("run", run).filter(F.col("run") <= F.col("part")).groupBy(*LEAF).agg(F.max("key").alias("last_in"))
    whole = sums.filter(F.col("ahead") + F.col("in_bucket") <= F.col("part")).groupBy(*LEAF).agg(F.max("bucket").alias("last_bucket"))
    out = budgets.join(last.hint("merge"), LEAF, "left").join(whole.hint("merge"), LEAF, "left")
    return write_table(out.select(*LEAF, "tokens", "budget", "full", F.coalesce("last_in", F.concat("last_bucket", F.lit("g"))).alias("last_key")), "plan")


def order_key(seed: int, epoch, name):
    """Place of a document in a seeded epoch."""
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), name).cast("binary")), F.lit(":"), name)


def small(leaves: DataFrame, most: int = MAX_BROADCAST_LEAVES) -> DataFrame:
    """Broadcast a written table of leaves if it has few rows, else leave it to a merge join."""
    return F.broadcast(leaves) if leaves.limit(most + 1).count() <= most else leaves.hint("merge")


def mix(docs: DataFrame, seed: int = SEED, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS, weight=default_weight) -> DataFrame:
    """docs with mix_domain, copies (times taken, at most max_epochs; 0: not taken), leaf_budget."""
    p = plan(docs, seed, share_percent, max_epochs, weight)
    p = p.select(F.col("domain").alias("leaf_domain"), F.col("lang").alias("leaf_lang"), F.col("source").alias("leaf_source"), F.col("budget").alias("leaf_budget"), "full", "last_key")
    d = with_leaf(packed(docs, "doc_id", "lang", "source")).join(small(p), ["leaf_domain", "leaf_lang", "leaf_source"])
    key = order_key(seed, F.col("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    copies = F.col("full") + F.when(F.coalesce(key <= F.col("last_key"), F.lit(False)), 1).otherwise(0)
    return unpacked(d.withColumn("copies", copies.cast("long")).withColumnRenamed("leaf_domain", "mix_domain"), docs.columns, "mix_domain", "leaf_budget", "copies")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with their leaf, its budget, and how often the mixture takes them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    out = mix(docs)
    return out.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", n_tokens(F.col("text")).alias("n_tokens"), "leaf_budget", "copies")


def oracle(seed: int = SEED, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> str:
    def level(name: str, nodes: str, parent: str, by: str) -> str:
        return f"""
{name}_o AS (
  SELECT *, budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         row_number() OVER (PARTITION BY {parent} ORDER BY cap / weight, {by}) AS no
  FROM ({nodes})),
{name}_m AS (SELECT *, min(CASE WHEN left_over * weight <= cap * rest THEN no END) OVER (PARTITION BY {parent}) AS mark FROM {name}_o),
{name} AS (
  SELECT a.* EXCLUDE (budget), CAST(CASE WHEN b.no IS NULL OR a.no < b.no THEN a.cap ELSE least(a.cap, (b.left_over * a.weight) // b.rest) END AS BIGINT) AS own
  FROM {name}_m a LEFT JOIN {name}_m b ON {' AND '.join(f'a.{c.strip()} = b.{c.strip()}' for c in parent.split(','))} AND b.no = a.mark)"""

    dom_w = "CASE domain WHEN 'domain0' THEN 3 WHEN 'domain1' THEN 2 ELSE 1 END"
    return (
        f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS s,
         'domain' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS HUGEINT), 0) % 3) AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens, coalesce(CAST(doc_id AS VARCHAR), '') AS name
  FROM documents),
leaf AS (SELECT domain, l, s, sum(n_tokens) AS tokens, sum(n_tokens) * {max_epochs} AS cap FROM d GROUP BY ALL),"""
        + level("dom", f"SELECT 0 AS root, domain, sum(cap) AS cap, {dom_w} AS weight, (SELECT (sum(tokens) * {share_percent}) // 100 FROM leaf) AS budget FROM leaf GROUP BY domain", "root", "domain")
        + ","
        + level("lng", "SELECT leaf.domain, l, sum(leaf.cap) AS cap, CASE l WHEN 'en' THEN 4 ELSE 2 END AS weight, any_value(own) AS budget FROM leaf JOIN dom ON leaf.domain = dom.domain GROUP BY leaf.domain, l", "domain", "l")
        + ","
        + level("src", "SELECT leaf.domain, leaf.l, s, leaf.cap, leaf.tokens, 1 AS weight, own AS budget FROM leaf JOIN lng ON leaf.domain = lng.domain AND leaf.l = lng.l", "domain, l", "s")
        + f""",
k AS (
  SELECT d.*, own AS leaf_budget, CASE WHEN tokens = 0 THEN 0 ELSE own // tokens END AS f, CASE WHEN tokens = 0 THEN 0 WHEN own // tokens < {max_epochs} THEN own % tokens ELSE -1 END AS part
  FROM d JOIN src ON d.domain = src.domain AND d.l = src.l AND d.s = src.s),
o AS (SELECT *, md5('{seed}:' || CAST(f AS BIGINT) || ':' || name) || ':' || name AS key FROM k)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, leaf_budget,
       CAST(f + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY key) <= part THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o"""
    )


ORACLE_OP9 = oracle()
