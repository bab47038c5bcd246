"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed are rules (host and path prefix, allow or block) and blocked canonical URLs. Each
entry sets one bit in each of the four 64-bit words of one 256-bit block. A URL asks for
its canonical form, and for every host suffix with every path prefix of a listed length;
what passes the filter goes to an exact join with the list, which removes the false
positives. The longest rule decides; without one, a listed canonical URL is blocked.

The filter is a table of at most MAX_BLOCKS blocks, whatever the list's length, and so
may be broadcast; the list itself is never. Hot entries are split by AQE's skew join.
Defined cases: a null URL or one without :// has an empty host and path and is allowed;
repeated rows are judged each; an empty table gives no rows; an empty list allows all;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .linededup import LOWER, UPPER

MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 12
#: fixed values: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: fixed values: a page holding one of these words puts its canonical URL on the list
FLAGGED_WORDS = ["trash", "clown", "idiot", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid"]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., path without index page and last slash; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/index\.html?)?/*$", ""))


def list_entries(rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """One table of all entries: key, rule, verdict (rule null: a canonical URL). listed: url."""
    spark = listed.sparkSession
    r = spark.createDataFrame([("R" + h + p, h + p, v) for h, p, v in rules], "key string, rule string, verdict string")
    u = listed.select(F.concat(F.lit("U"), canonical(host_of(F.col("url")), path_of(F.col("url")))).alias("key")).filter("key > 'U'").distinct()
    return r.unionByName(u.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("block")}))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def bloom_blocks(entries: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w3: the set bits of each used block."""
    d = entries.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"b{k}") for k, b in enumerate(_bits(F.col("key")))])
    return d.groupBy("block").agg(*[F.bit_or(f"b{k}").alias(f"w{k}") for k in range(4)])


def may_hold(asks: DataFrame, filter_table: DataFrame, blocks: int) -> DataFrame:
    """Rows of asks (with key) that the filter lets pass."""
    d = asks.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(filter_table), "block")
    all_set = F.lit(True)
    for k, b in enumerate(_bits(F.col("key"))):
        all_set = all_set & (F.col(f"w{k}").bitwiseAND(b) != 0)
    return d.filter(all_set).drop("block", "w0", "w1", "w2", "w3")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every row of pages (page_id, url)."""
    entries = write_table(list_entries(rules, listed), "entries")
    blocks = max(1, min(MAX_BLOCKS, entries.count() // KEYS_PER_BLOCK))
    bloom = bloom_blocks(entries, blocks)
    d = pages.select("page_id", F.xxhash64("url").alias("uh"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(n) for n in sorted({len(p) for _, p, _ in rules})])
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    asks = F.concat(F.array(F.concat(F.lit("U"), canonical(F.col("host"), F.col("path")))), F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("R"), s, p)))))
    hits = may_hold(d.filter("host > ''").select("page_id", "uh", F.explode(asks).alias("key")), bloom, blocks)
    # rules are a short list, and keys of theirs are the most common ones
    of_rules = hits.filter(F.col("key").startswith("R")).join(F.broadcast(entries.filter("rule is not null")), "key")
    of_list = hits.filter(F.col("key").startswith("U")).join(entries.filter("rule is null").hint("merge"), "key")
    exact = of_rules.unionByName(of_list).select("page_id", "uh", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("n"), F.when(F.col("rule").isNotNull(), F.struct(F.char_length("rule").alias("len"), "rule", "verdict")).alias("best"), F.col("rule").isNull().alias("listed"))
    base = d.select("page_id", "uh", "host", "path", F.lit(1).alias("n"), F.lit(None).cast("struct<len:int,rule:string,verdict:string>").alias("best"), F.lit(False).alias("listed"))
    g = base.unionByName(exact).groupBy("page_id", "uh").agg(F.max("host").alias("host"), F.max("path").alias("path"), F.sum("n").alias("n"), F.max("best").alias("best"), F.max("listed").alias("listed"))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return g.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "listed")


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    """Contract query: every page's URL against the rules and the canonical URLs of flagged pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    flagged = pages.filter(F.col("html").rlike(rf"\b({'|'.join(FLAGGED_WORDS)})\b")).select("url")
    return filter_urls(pages.select("page_id", "url"), flagged)


def _oracle() -> str:
    parsed = f"""
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{_URL}', 2), '') AS path
  FROM pages"""
    rules = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in RULES)
    return rf"""
WITH u AS ({parsed}),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/index\.html?)?/*$', '') AS canon FROM u),
l AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(html, '\b({'|'.join(FLAGGED_WORDS)})\b') AND canon <> ''),
r AS ({rules}),
m AS (
  SELECT page_id, url, arg_max(h || p, (length(h || p), h || p)) AS rule, arg_max(v, (length(h || p), h || p)) AS v
  FROM (SELECT DISTINCT page_id, url, host, path FROM u), r
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.v, CASE WHEN l.canon IS NULL THEN 'allow' ELSE 'block' END) AS verdict, l.canon IS NOT NULL AS listed
FROM c LEFT JOIN m ON c.page_id IS NOT DISTINCT FROM m.page_id AND c.url IS NOT DISTINCT FROM m.url LEFT JOIN l ON c.canon = l.canon AND c.host <> ''
"""


ORACLE_OP2 = _oracle()
