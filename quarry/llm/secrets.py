"""Secret scans over a trigram inverted index.

Each rule is a regex. From its parse tree come alternatives of literal runs, and from
these a Boolean query of trigrams: an OR of ANDs. The index has, for each trigram that
some rule asks for, the documents whose text holds it (A-Z lower-cased). Postings are
intersected per document and clause, and only candidate documents are matched against
the rule's regex. Rules without mandatory trigrams (such as runs of hex digits) are
matched against every text. Texts are matched whole.

Spans are in code points, end exclusive, leftmost and non-overlapping per kind.
Defined cases: a null or empty text has no spans; postings belong to (doc_id, text hash),
so repeated rows and null doc_ids are scanned each; an empty table gives no rows; other
columns are ignored. DataFrame functions only; Python just prepares the rules.
"""

from __future__ import annotations

import re._constants as rc
import re._parser as rp
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table

GAP = None
MAX_ALTERNATIVES = 48
MAX_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """Matches of pattern whose group `group` has `least` code points are spans of `kind`."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: fixed values: the three base rules (hex with its least length in the pattern, which gives the same runs)
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
]
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
]


def _cross(left: list[tuple], right: list[tuple]) -> list[tuple]:
    if len(left) * len(right) > MAX_ALTERNATIVES:
        right = [(GAP,)]
    return list(dict.fromkeys(a + b for a in left for b in right))


def _alternatives(tree) -> list[tuple]:
    """Sequences of characters and gaps, of which every match follows one."""
    out: list[tuple] = [()]
    for op, arg in tree:
        if op is rc.LITERAL:
            one = [(chr(arg).lower(),)]
        elif op is rc.IN:
            chars: list[str] | None = []
            for kind, x in arg:
                if kind is rc.LITERAL:
                    chars.append(chr(x))
                elif kind is rc.RANGE and x[1] - x[0] < MAX_CLASS:
                    chars += map(chr, range(x[0], x[1] + 1))
                else:
                    chars = None
                    break
            one = [(c,) for c in dict.fromkeys(c.lower() for c in chars)] if chars and len(chars) <= MAX_CLASS else [(GAP,)]
        elif op is rc.SUBPATTERN:
            one = _alternatives(arg[3])
        elif op is rc.BRANCH:
            one = list(dict.fromkeys(a for t in arg[1] for a in _alternatives(t)))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            least, most, sub = arg
            if (least, most) == (0, 1):
                one = [(), *_alternatives(sub)]
            else:
                one = [()]
                for _ in range(min(least, 3)):
                    one = _cross(one, _alternatives(sub))
                if most > min(least, 3):
                    one = [a + (GAP,) for a in one]
        elif op is rc.AT:
            continue
        else:
            one = [(GAP,)]
        out = _cross(out, one)
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of lower-case trigrams that any match needs; empty: nothing is mandatory."""
    clauses: set[frozenset[str]] = set()
    for alt in _alternatives(rp.parse(pattern)):
        runs, run = [], ""
        for c in (*alt, GAP):
            if c is GAP:
                runs.append(run)
                run = ""
            else:
                run += c
        clauses.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    if frozenset() in clauses:
        return []
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


def index_trigrams(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: a posting (trigram, doc_id, th) for each of the trigrams that a text holds."""
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return d.select(F.explode(held).alias("trigram"), "doc_id", "th")


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """Intersect postings: doc_id, th, kinds (rules of which a clause is complete)."""
    spark = postings.sparkSession
    terms = [(k, n, t, 1 << i, (1 << len(c)) - 1) for k, q in queries.items() for n, c in enumerate(q) for i, t in enumerate(sorted(c))]
    table = spark.createDataFrame(terms, "kind string, clause int, trigram string, bit long, full long")
    met = postings.join(F.broadcast(table), "trigram").groupBy("doc_id", "th", "kind", "clause").agg(F.bit_or("bit").alias("bits"), F.max("full").alias("full"))
    return met.filter("bits = full").groupBy("doc_id", "th").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, no: int) -> Column:
    """array<struct<start, no, end>> of a rule's spans; pieces between matches give the offsets."""
    p = F.lit(rule.pattern)
    parts, found, held = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(rule.group))
    rows = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("part"), found.alias("found"), held.alias("held"))
    none = F.array().cast("array<struct<start:int,no:int,end:int>>")
    got = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.char_length(x["part"]) + F.char_length(x["found"])).alias("at"),
            F.when(
                F.char_length(x["held"]) >= rule.least,
                F.array_append(a["out"], F.struct((a["at"] + F.char_length(x["part"])).alias("start"), F.lit(no).alias("no"), (a["at"] + F.char_length(x["part"]) + F.char_length(x["found"])).alias("end"))),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(rule.pattern), got).otherwise(none)


def scan_secrets(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, text, found: array<struct<start, no, end>> by start, then rule number."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = {k: q for k, q in queries.items() if q}
    trigrams = sorted({t for q in asked.values() for c in q for t in c})
    postings = write_table(index_trigrams(docs, trigrams).sortWithinPartitions("trigram"), "postings")
    cand = candidates(postings, asked).select(F.col("doc_id").alias("c_doc"), F.col("th").alias("c_th"), "kinds")
    d = docs.withColumn("th", F.xxhash64("text"))
    d = d.join(cand.hint("shuffle_hash"), d["doc_id"].eqNullSafe(F.col("c_doc")) & (d["th"] == F.col("c_th")), "left")
    none = F.array().cast("array<struct<start:int,no:int,end:int>>")
    each = []
    for no, r in enumerate(rules):
        spans = _spans(F.col("text"), r, no)
        each.append(spans if r.kind not in asked else F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)), spans).otherwise(none))
    return d.select("doc_id", "text", F.array_sort(F.concat(*each)).alias("found"))


def _digest(found: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["no"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Contract query: secrets in all documents."""
    rules = BASE_RULES + MORE_RULES
    kinds = [r.kind for r in rules]
    d = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), rules).drop("text")
    count = lambda no: F.size(F.filter("found", lambda x: x["no"] == no)).cast("long")
    base = F.filter("found", lambda x: x["no"] < len(BASE_RULES))
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_digest(base, kinds).cast("binary"), 256).alias("base_sha256"), _digest(F.col("found"), kinds).alias("spans"))
