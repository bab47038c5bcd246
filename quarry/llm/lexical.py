"""Ranked lexical search: posting lists cut into blocks of similar documents, skipped by exact bounds.

A document's score for an item is the sum, over the item's terms, of the term's weight times
an impact of its frequency and the document's length, all in whole numbers. Every document is
indexed for the terms of the items:

1. One scan of the whole texts makes vectors (place, doc_id, number of terms, frequencies of
   item terms), written once; document frequencies are counted over all of them.
2. Floors: for each item, the documents that hold one of its rarest terms are scored; the
   `top`-th best of these scores is a floor under the final one.
3. An item's terms are ordered by the most they can give. The longest run of weakest terms
   whose sum stays below the floor needs no lists: a document with these terms only can't
   rank. The others are the item's lists.
4. Vectors are sorted by signs of random projections over all partitions, so that similar
   documents lie together, and each list is cut along this order into blocks of `block`
   documents. A block's summary is the maximum of each coordinate over its documents; its
   coordinates are the terms of all items that need the list. Blocks are written.
5. A block is skipped for an item only if its summary, weighted as the item, gives less than
   the floor: no document in it can reach more. All documents of the other blocks are scored
   in full from their vectors, and each item's best are kept, first by task.

Items are dealt into sets of about MAX_TERMS terms, one after the other; what tasks get of a
set (weights, lists, floors) is bounded by that. Terms are told apart by 64-bit hashes.

Defined cases: null or termless texts are in no list and not counted; very long texts are
scanned whole, a slice each; repeated rows are documents of their own, repeated items get a
ranking each; ties go by doc_id (null last), then by place; a null item_id is kept; items
without terms, or an empty table, give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_table, write_table
from .text import ALNUM_WORD, mix, scan_words

TOP = 10
#: documents in a block; terms in a set of items; cells of a dense piece of the vectors; documents that the rarest terms of an item should give for its floor
BLOCK, MAX_TERMS, CELLS, SEEDS = 32, 1 << 14, 1 << 24, 200
#: signs of random projections in a document's signature
SIGNS = 32


# ------------------------------------------------------------------ items


@dataclass
class Items:
    """A set of items: number of each, its term ids and how often it has each."""

    vocab: np.ndarray
    no: np.ndarray
    terms: list[np.ndarray]
    times: list[np.ndarray]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        no = b.column("item_no").to_numpy()
        for i, j, w in scan_words(b.column("text"), ALNUM_WORD):
            for d in range(j - i):
                h, n = np.unique(w.hashes[w.first[d] : w.first[d + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), no[i + d])), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["item_no", "h", "times"])


def item_sets(items: DataFrame, max_terms: int) -> Iterator[Items]:
    """items: item_no, text. Sets of about max_terms terms."""
    terms = write_table(items.select("item_no", "text").mapInArrow(_item_terms, "item_no long, h long, times long"), "item_terms")
    sets = -(-terms.count() // max_terms)
    for k in range(sets):
        got = terms.filter(F.pmod(F.xxhash64("item_no"), F.lit(sets)) == k).toArrow()
        if not got.num_rows:
            continue
        no, h, n = (got.column(c).to_numpy() for c in ("item_no", "h", "times"))
        vocab, at = np.unique(h.view(np.uint64), return_inverse=True)
        own, of = np.unique(no, return_inverse=True)
        parts = [np.flatnonzero(of == i) for i in range(len(own))]
        yield Items(vocab, own, [at[p] for p in parts], [n[p] for p in parts])
    drop_table(terms)


# ------------------------------------------------------------------ vectors


def _vectors(vocab):
    """place, doc_id, n, term ids (rising) and frequencies of each text with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for b in batches:
            rows = b.num_rows
            n, lens = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            tids, tfs = [], []
            for i, j, w in scan_words(b.column("text"), ALNUM_WORD):
                n[i:j] = w.count()
                at = np.minimum(np.searchsorted(v, w.hashes), len(v) - 1)
                hit = np.flatnonzero(v[at] == w.hashes)
                doc = np.searchsorted(w.first, hit, side="right") - 1
                key, tf = np.unique(doc * len(v) + at[hit], return_counts=True)
                lens[i:j] = np.bincount(key // len(v), minlength=j - i)
                tids.append(key % len(v))
                tfs.append(tf)
            off = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
            flat = [pa.array((np.concatenate(x) if x else np.zeros(0)).astype(np.int32)) for x in (tids, tfs)]
            out = pa.RecordBatch.from_arrays([b.column("no"), b.column("doc_id"), pa.array(n), *(pa.ListArray.from_arrays(off, f) for f in flat)], ["no", "doc_id", "n", "tids", "tfs"])
            yield out.filter(pa.array(n > 0))

    return run


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()


def _doc_counts(size: int):
    """(term id, documents) of a task, with the number of documents as -1 and of terms as -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            df += np.bincount(flat(b.column("tids"))[1], minlength=size)
            docs += b.num_rows
            total += int(b.column("n").to_numpy().sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], at])), pa.array(np.concatenate([[docs, total], df[at]]))], ["tid", "c"])

    return run


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Impact of a frequency in a document of n terms."""
    m = 100 - 75 + (75 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


@dataclass
class Search:
    """What tasks know of a set of items: numbers, sizes of the collection, weights, floors and lists."""

    no: np.ndarray
    docs: int
    total: int
    weights: np.ndarray
    terms: list[np.ndarray]
    #: weight times repeats of each term of each item
    gains: list[np.ndarray]
    #: terms of each item whose documents give its floor
    seeds: list[np.ndarray]
    floors: np.ndarray
    #: for each list its coordinates, and the items that need it with the places of their terms among the coordinates
    coords: dict[int, np.ndarray]
    needed: dict[int, list[tuple[int, np.ndarray]]]


def dense(b: pa.RecordBatch, s: Search) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, impacts by document and term, rows of entries, their terms) of pieces of a batch of vectors."""
    lens, tid = flat(b.column("tids"))
    tf = flat(b.column("tfs"))[1]
    first = np.concatenate([[0], np.cumsum(lens)])
    n = b.column("n").to_numpy()
    step = max(1, CELLS // len(s.weights))
    for i in range(0, b.num_rows, step):
        j = min(i + step, b.num_rows)
        row = np.repeat(np.arange(j - i), lens[i:j])
        t = tid[first[i] : first[j]]
        x = np.zeros((j - i, len(s.weights)), np.float32)
        # impacts are below 2^24, so they are exact
        x[row, t] = impacts(tf[first[i] : first[j]].astype(np.int64), n[i:j][row], s.docs, s.total)
        yield i, x, row, t


class Best:
    """The best (score, rank) rows of each item in a task; equal scores by rising rank."""

    def __init__(self, top: int):
        self.top, self.kept = top, {}

    def add(self, item: int, score: np.ndarray, rank: np.ndarray) -> None:
        if item in self.kept:
            score, rank = (np.concatenate(p) for p in zip(self.kept[item], (score, rank), strict=True))
        at = np.lexsort((rank, -score))[: self.top]
        self.kept[item] = (score[at], rank[at])

    def rows(self) -> pa.RecordBatch:
        nothing = [np.zeros(0, np.int64)]
        item = np.concatenate(nothing + [np.full(len(v[0]), k, np.int64) for k, v in self.kept.items()])
        parts = [np.concatenate(nothing + [v[i] for v in self.kept.values()]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (item, *parts)], ["item", "score", "rank"])


def _floors(search, top: int):
    """The best scores of documents that hold a seed term, and the most each term gives anywhere in the task (item -1 - term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, best = search.value, Best(top)
        most = np.zeros(len(s.weights), np.float32)
        for b in batches:
            no = b.column("no").to_numpy()
            for i, x, _, _ in dense(b, s):
                np.maximum(most, x.max(axis=0, initial=0), out=most)
                for q, seed in enumerate(s.seeds):
                    hit = np.flatnonzero(x[:, seed].any(axis=1))
                    if len(hit):
                        score = (x[np.ix_(hit, s.terms[q])].astype(np.float64) @ s.gains[q]).astype(np.int64)
                        best.add(q, score, no[i + hit])
        yield best.rows()
        at = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array((-1 - at).astype(np.int64)), pa.array(most[at].astype(np.int64)), pa.array(np.zeros(len(at), np.int64))], ["item", "score", "rank"])

    return run


def _signed(search):
    """Vectors with the signature of their weighted impacts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = search.value
        bits = mix(np.arange(1, len(s.weights) + 1, dtype=np.uint64))
        side = (((bits[:, None] >> np.arange(SIGNS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1) * s.weights[:, None].astype(np.float32)
        for b in batches:
            sign = np.zeros(b.num_rows, np.int64)
            for i, x, _, _ in dense(b, s):
                sign[i : i + len(x)] = ((x @ side) > 0) @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sign)], [*b.schema.names, "sign"])

    return run


def _blocks(search, block: int):
    """list, nos, summary of the blocks that a run of sorted vectors gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = search.value
        listed = np.zeros(len(s.weights), bool)
        listed[list(s.coords)] = True
        for b in batches:
            no = b.column("no").to_numpy()
            for i, x, row, t in dense(b, s):
                own = listed[t]
                row, t = row[own], t[own]
                if not len(t):
                    continue
                order = np.argsort(t, kind="stable")
                row, t = row[order], t[order]
                lists, first = np.unique(t, return_index=True)
                ends = np.append(first[1:], len(t))
                tid, nos, sums = [], [], []
                for term, lo, hi in zip(lists.tolist(), first.tolist(), ends.tolist(), strict=True):
                    rows = row[lo:hi]
                    cuts = np.arange(0, len(rows), block)
                    got = np.maximum.reduceat(x[np.ix_(rows, s.coords[term])], cuts, axis=0)
                    tid += [term] * len(cuts)
                    nos += np.split(no[i + rows], cuts[1:])
                    sums += list(got)
                if tid:
                    yield pa.RecordBatch.from_arrays([pa.array(tid, pa.int32()), pa.array(nos, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.float32()))], ["list", "nos", "summary"])

    return run


def _open_blocks(search):
    """(place, item) of the documents of blocks whose summary reaches the item's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = search.value
        for b in batches:
            tid = b.column("list").to_numpy()
            lens, nos = flat(b.column("nos"))
            first = np.concatenate([[0], np.cumsum(lens)])
            wide, sums = flat(b.column("summary"))
            at = np.concatenate([[0], np.cumsum(wide)])
            out_no, out_item = [], []
            for term in np.unique(tid).tolist():
                rows = np.flatnonzero(tid == term)
                m = sums[at[rows][:, None] + np.arange(wide[rows[0]])].astype(np.float64)
                for q, places in s.needed[term]:
                    bound = m[:, places] @ s.gains[q]
                    for r in rows[(bound >= s.floors[q]) & (bound > 0)]:
                        out_no.append(nos[first[r] : first[r + 1]])
                        out_item.append(np.full(lens[r], q, np.int64))
            if out_no:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_no)), pa.array(np.concatenate(out_item))], ["no", "item"])

    return run


def _scored(search, top: int):
    """Each item's best of the documents that are to be scored for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, best = search.value, Best(top)
        for b in batches:
            rank = b.column("rank").to_numpy()
            lens, item = flat(b.column("items"))
            row = np.repeat(np.arange(b.num_rows), lens)
            for i, x, _, _ in dense(b, s):
                inside = (row >= i) & (row < i + len(x))
                for q in np.unique(item[inside]).tolist():
                    r = row[inside & (item == q)]
                    score = (x[np.ix_(r - i, s.terms[q])].astype(np.float64) @ s.gains[q]).astype(np.int64)
                    good = score > 0
                    best.add(q, score[good], rank[r[good]])
        best.kept = {int(s.no[q]): v for q, v in best.kept.items()}
        yield best.rows()

    return run


def lists_of(s: Search, most: np.ndarray) -> None:
    """Each item's lists, and for each list its coordinates."""
    of: dict[int, list[int]] = {}
    for q, (t, g) in enumerate(zip(s.terms, s.gains, strict=True)):
        gives = most[t] * g
        order = np.argsort(gives, kind="stable")
        weak = np.cumsum(gives[order]) < s.floors[q]
        for term in t[order[~weak & (gives[order] > 0)]].tolist():
            of.setdefault(term, []).append(q)
    s.coords = {term: np.unique(np.concatenate([s.terms[q] for q in qs])) for term, qs in of.items()}
    s.needed = {term: [(q, np.searchsorted(s.coords[term], s.terms[q])) for q in qs] for term, qs in of.items()}


def ranked(docs: DataFrame, items: Items, top: int, block: int) -> DataFrame:
    """item (place in the set), rank, doc_id, score; docs: no, doc_id, text."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = len(items.vocab)
    shape = f"no long, doc_id {kind}, n long, tids array<int>, tfs array<int>"
    vocab = sc.broadcast(items.vocab)
    vectors = write_table(docs.mapInArrow(_vectors(vocab), shape), "vectors")
    counts = {r["tid"]: r["c"] for r in vectors.select("n", "tids").mapInArrow(_doc_counts(size), "tid long, c long").groupBy("tid").agg(F.sum("c").alias("c")).collect()}
    n, total = counts.get(-1, 0), counts.get(-2, 0)
    df = np.array([counts.get(t, 0) for t in range(size)])
    weights = np.array([weight(int(d), n) for d in df], dtype=np.int64)
    seeds = []
    for t in items.terms:
        rare = t[df[t] > 0][np.argsort(df[t[df[t] > 0]], kind="stable")]
        seeds.append(rare[: int(np.searchsorted(np.cumsum(df[rare]), SEEDS)) + 1])
    s = Search(items.no, n, max(total, 1), weights, items.terms, [(weights[t] * c).astype(np.float64) for t, c in zip(items.terms, items.times, strict=True)], seeds, np.zeros(len(items.no)), {}, {})
    first = sc.broadcast(s)
    got = vectors.drop("doc_id").mapInArrow(_floors(first, top), "item long, score long, rank long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
    tops = got.filter("item >= 0").withColumn("place", place).filter(F.col("place") == top).select("item", "score")
    most = got.filter("item < 0").groupBy("item").agg(F.max("score").alias("score"))
    known = {r["item"]: r["score"] for r in tops.unionByName(most).collect()}
    s.floors = np.array([float(known.get(q, 0)) for q in range(len(items.no))])
    lists_of(s, np.array([known.get(-1 - t, 0) for t in range(size)], dtype=np.float64))
    search = sc.broadcast(s)
    near = vectors.drop("doc_id").filter(F.size("tids") > 0).mapInArrow(_signed(search), "no long, n long, tids array<int>, tfs array<int>, sign long")
    near = write_table(near, "signed")
    ordered = near.repartitionByRange("sign", "no").sortWithinPartitions("sign", "no")
    blocks = write_table(ordered.mapInArrow(_blocks(search, block), "list int, nos array<long>, summary array<float>"), "blocks")
    drop_table(near)
    open_ = blocks.mapInArrow(_open_blocks(search), "no long, item long").groupBy("no").agg(F.collect_set("item").alias("items"))
    open_written = write_table(open_, "open")
    open_ = open_written.withColumnRenamed("no", "open_no")
    drop_table(blocks)
    met = vectors.join(open_.hint("shuffle_hash"), F.col("no") == F.col("open_no"))
    # the place in doc_id's order, of any type, is what ties go by
    nulls_last = F.col("doc_id").isNull()
    met = met.repartitionByRange(nulls_last, "doc_id", "no").sortWithinPartitions(nulls_last, "doc_id", "no")
    met = write_table(met.select(F.monotonically_increasing_id().alias("rank"), "doc_id", "n", "tids", "tfs", "items"), "met")
    drop_table(vectors, open_written)
    best = met.drop("doc_id").mapInArrow(_scored(search, top), "item long, score long, rank long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "rank"))
    best = best.withColumn("place", place).filter(F.col("place") <= top).withColumnRenamed("rank", "at")
    best = best.join(met.select("rank", "doc_id").hint("merge"), F.col("at") == F.col("rank"))
    out = write_table(best.select(F.col("item").alias("item_no"), F.col("place").cast("int").alias("rank"), "doc_id", "score"), "ranked")
    drop_table(met)
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, max_terms: int = MAX_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of items (item_id, text) its best of docs (doc_id, text)."""
    items = write_table(items.select("item_id", "text", F.monotonically_increasing_id().alias("item_no")), "items")
    docs = docs.select(F.monotonically_increasing_id().alias("no"), "doc_id", "text")
    out = items.sparkSession.createDataFrame([], f"item_no long, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    for some in item_sets(items, max_terms):
        out = out.unionByName(ranked(docs, some, top, block))
    own = items.select(F.col("item_no").alias("i_no"), "item_id")
    return out.join(own.hint("merge"), F.col("item_no") == F.col("i_no")).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """Contract query: the ten best of all documents for every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_OP12 = r"""
WITH
t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN d USING (doc_id) JOIN w USING (term), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
"""
