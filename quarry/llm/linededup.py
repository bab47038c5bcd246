"""Line de-duplication with levelled sorted runs of line hashes.

A line's key is the line stripped of white space and with A-Z lower-cased; keys of at
least `min_chars` code points count. Documents come in batches, largest doc_ids first.
The store holds sorted runs of (key hash, documents, largest doc_id); each batch is
merge-anti-joined with the keys that the runs have settled (enough documents found, and
the keeper known, as later batches have only smaller doc_ids), and what is left is added
as a run of its own. When a level has `fan_out` runs they are compacted into one of the
next level. At the end the runs' totals say which keys repeat; their lines go, but for
those in the largest doc_id.

Key hashes have 128 bits. Defined cases: a null or empty text is one empty line; rows of
one doc_id are one document when documents are counted, and all keep their lines when it
is the largest; null doc_ids are one document, smaller than all others; doc_ids of any
ordered type do; very long texts are split whole; an empty table gives no rows; other
columns come back unchanged, one that bears the name of a result as own_<name>.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import write_table
from .rows import packed, unpacked

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line that counts: doc_id, th (hash of the text), pos, h1, h2, first (first of its key in the text)."""
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), F.transform(_lines(F.col("text")), line_key).alias("keys"))
    d = d.select(
        "doc_id",
        "th",
        F.array_sort(
            F.filter(
                F.transform("keys", lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2"), i.alias("pos")))),
                lambda x: x.isNotNull(),
            )
        ).alias("ks"),
    )
    first = F.expr("transform(ks, (x, i) -> named_struct('h1', x.h1, 'h2', x.h2, 'pos', x.pos, 'first', i = 0 or ks[i - 1].h1 <> x.h1 or ks[i - 1].h2 <> x.h2))")
    return d.select("doc_id", "th", F.explode(first).alias("x")).select("doc_id", "th", "x.*")


class LineRuns:
    """Levelled sorted runs of (h1, h2, docs, keeper)."""

    def __init__(self, settled_at: int, fan_out: int = 2):
        self.settled_at, self.fan_out = settled_at, fan_out
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, docs, keeper; its doc_ids are not larger than those of earlier batches."""
        if self.runs():
            settled = self._union(self.runs()).filter(F.col("docs") >= self.settled_at).select("h1", "h2")
            batch = batch.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, batch)

    def _put(self, level: int, rows: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(write_table(rows.sortWithinPartitions("h1", "h2"), f"level{level}"))
        if len(self.levels[level]) >= self.fan_out:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merged(self._union(full)))

    def totals(self) -> DataFrame:
        return self._merged(self._union(self.runs()))


def batch_cuts(lines: DataFrame, batches: int) -> list:
    """doc_ids that part the batches, falling. Any cuts give the same result, so other than numbers are cut by a few hundred of them."""
    if batches < 2:
        return []
    if isinstance(lines.schema["doc_id"].dataType, NumericType):
        return lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)], 1000).alias("c")).first()["c"] or []
    ids = lines.select("doc_id").filter("doc_id is not null").distinct()
    few = sorted(r[0] for r in ids.orderBy(F.xxhash64("doc_id")).limit(500).collect())
    return sorted({few[len(few) * i // batches] for i in range(1, batches)}, reverse=True) if few else []


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """docs with kept (the text without repeated lines), n_lines and n_dropped instead of text."""
    lines = write_table(line_hashes(docs, min_chars), "lines")
    cuts = batch_cuts(lines, batches)
    # rows of one doc_id count once; where no doc_id is repeated, every row does
    repeats = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    store = LineRuns(min_docs, fan_out)
    no = F.col("doc_id")
    for i in range(len(cuts) + 1):
        part = F.lit(True)
        if i:
            part = (no < cuts[i - 1]) if i < len(cuts) else ((no < cuts[i - 1]) | no.isNull())
        if i < len(cuts):
            part = part & (no >= cuts[i])
        own = lines.filter(part & F.col("first")).select("h1", "h2", "doc_id")
        batch = (own.distinct() if repeats else own).groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        store.add(batch)
    repeated = write_table(store.totals().filter(F.col("docs") >= min_docs).select("h1", "h2", "keeper"), "repeated")
    drops = (
        lines.join(repeated.hint("merge"), ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("th").alias("of_th"))
        .agg(F.array_distinct(F.collect_list("pos")).alias("drop"))
    )
    d = packed(docs, "doc_id", "text", th=F.xxhash64("text"))
    d = d.join(drops.hint("shuffle_hash"), d["doc_id"].eqNullSafe(drops["of_doc"]) & (d["th"] == drops["of_th"]), "left")
    d = d.withColumn("lines", _lines(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda p: F.get(F.col("lines"), p)), "\n"))
    d = d.withColumns({"kept": kept, "n_lines": F.size("lines").cast("long"), "n_dropped": F.coalesce(F.size("drop"), F.lit(0)).cast("long")})
    return unpacked(d, [c for c in docs.columns if c != "text"], "kept", "n_lines", "n_dropped")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: line de-duplication of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_OP3 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
