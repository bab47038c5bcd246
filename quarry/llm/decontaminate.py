"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of `window` consecutive words (all words, if fewer). A
window is a set of word shingles (3 words) with their offsets. Shingles are ordered by
rarity, counted over all documents. As a window must be contained whole, one prefix
token, its rarest shingle, is enough: documents' occurrences of prefix shingles are
joined with the windows, the offset gives where the window would have to stand, length
and positional bounds cut what can't fit, and the words are compared exactly.

Documents are scanned twice, with bitmaps of fixed size that let pass possible shingles;
the joins are exact and by shuffle, whatever the size of the benchmark. Defined cases:
null or wordless texts have no windows and no hits; repeated rows and null doc_ids are
judged each; repeated items count once; empty tables give no hits or no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..session import write_table
from . import bits as bitmaps
from .linededup import LOWER, UPPER
from .text import ALNUM_WORD, scan_words, shingles

WINDOW = 10
SHINGLE = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """win (words joined by blanks), size, item_id; distinct."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return w.select("item_id", F.explode(F.transform(at, lambda i: F.slice("w", i, window))).alias("v")).select(F.array_join("v", " ").alias("win"), F.size("v").alias("size"), "item_id").distinct()


def _window_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        wins, sizes, out = b.column("win"), b.column("size").to_numpy(zero_copy_only=False), ([], [], [], [])
        for i, j, w in scan_words(wins, ALNUM_WORD):
            for d in range(j - i):
                h = shingles(w.hashes[w.first[d] : w.first[d + 1]], SHINGLE).view(np.int64)
                out[0].extend([wins[i + d].as_py()] * len(h))
                out[1].extend([int(sizes[i + d])] * len(h))
                out[2].extend(h.tolist())
                out[3].extend(range(len(h)))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], ["win", "size", "h", "offset"])


def _count_shingles(bits, ks: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for i, j, w in scan_words(b.column("text"), ALNUM_WORD):
                for _, s in _doc_shingles(w, ks):
                    got.append(s[bitmaps.held(bits.value, s)])
            h, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def _doc_shingles(w, ks: list[int]):
    """(first word of each, hashes) of the k-word shingles of all documents of a slice; none spans two documents."""
    doc_end = np.repeat(w.first[1:], np.diff(w.first))
    for k in ks:
        if len(w.hashes) >= k:
            at = np.flatnonzero(np.arange(len(w.hashes) - k + 1) + k <= doc_end[: len(w.hashes) - k + 1])
            yield at, shingles(w.hashes, k)[at]


def _find(bits, ks: list[int], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = np.zeros(b.num_rows, dtype=np.int64)
            cands: list[list] = [[] for _ in range(b.num_rows)]
            for i, j, w in scan_words(b.column("text"), ALNUM_WORD):
                n_words[i:j] = w.count()
                for at, s in _doc_shingles(w, ks):
                    hit = np.flatnonzero(bitmaps.held(bits.value, s))
                    for p, h in zip(at[hit].tolist(), s[hit].view(np.int64).tolist(), strict=True):
                        d = int(np.searchsorted(w.first, p, side="right")) - 1
                        lo, hi = max(int(w.first[d]), p - window + 1), min(int(w.first[d + 1]), p + window)
                        ctx = b" ".join(bytes(w.data[w.starts[x] : w.ends[x]]) for x in range(lo, hi)).decode()
                        cands[i + d].append({"h": h, "pos": p - int(w.first[d]), "ctx_at": lo - int(w.first[d]), "ctx": ctx})
            kind = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("ctx_at", pa.int32()), ("ctx", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n_words), pa.array(cands, kind)], ["doc_id", "th", "n_words", "cands"])

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, item_ids (array) of every row of docs."""
    sc = docs.sparkSession.sparkContext
    windows = write_table(item_windows(items, window), "windows")
    tokens = write_table(windows.select("win", "size").distinct().mapInArrow(_window_shingles, "win string, size int, h long, offset int"), "window_shingles")
    ks = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    all_bits = sc.broadcast(bitmaps.bitmap(tokens))
    seen = texts.select("text").mapInArrow(_count_shingles(all_bits, ks), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    ranked = tokens.join(seen.hint("merge"), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = write_table(ranked.groupBy("win", "size").agg(F.min(F.struct("n", "h", "offset")).alias("rarest")).select("win", "size", "rarest.h", "rarest.offset"), "prefix")
    own_bits = sc.broadcast(bitmaps.bitmap(prefix))
    kind = texts.schema["doc_id"].dataType.simpleString()
    scanned = write_table(texts.mapInArrow(_find(own_bits, ks, window), f"doc_id {kind}, th long, n_words long, cands array<struct<h:long,pos:int,ctx_at:int,ctx:string>>"), "scanned")
    cands = scanned.select("doc_id", "th", "n_words", F.explode("cands").alias("c")).select("doc_id", "th", "n_words", "c.*")
    start = F.col("pos") - F.col("offset")
    met = cands.join(prefix.hint("merge"), "h").filter((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    met = met.filter(F.array_join(F.slice(F.split("ctx", " "), start - F.col("ctx_at") + 1, F.col("size")), " ") == F.col("win"))
    of_window = windows.groupBy("win").agg(F.collect_set("item_id").alias("items"))
    hits = met.select("doc_id", "th", "win", start.alias("start"), "size").distinct().join(of_window.hint("merge"), "win")
    span = F.struct("start", "size")
    rows = scanned.select("doc_id", "th", "n_words", F.lit(1).alias("n"), F.lit(None).cast("struct<start:int,size:int>").alias("span"), F.lit(None).cast(ArrayType(items.schema["item_id"].dataType)).alias("items"))
    rows = rows.unionByName(hits.select("doc_id", "th", F.lit(None).cast("long").alias("n_words"), F.lit(0).alias("n"), span.alias("span"), "items"))
    g = rows.groupBy("doc_id", "th").agg(F.max("n_words").alias("n_words"), F.sum("n").alias("n"), F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))
    return g.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("doc_id", "th", "n_words", n_hit.cast("long").alias("n_hit"), "item_ids")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents against all benchmark items."""
    d = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return d.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT win, len(string_split(win, ' ')) AS size FROM v),
t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
m AS (SELECT doc_id, w, win, size FROM t, s WHERE contains(t, ' ' || win || ' ')),
p AS (SELECT * FROM (SELECT doc_id, w, win, size, unnest(range(1, len(w) - size + 2)) AS i FROM m) WHERE array_to_string(list_slice(w, i, i + size - 1), ' ') = win),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS x FROM p) GROUP BY doc_id),
n AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM p JOIN v ON p.win = v.win) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
