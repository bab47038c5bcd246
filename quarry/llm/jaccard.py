"""N-gram Jaccard join over 5-word shingles with token-combination prefixes.

A document's set is its distinct shingles (all its words as one, if fewer than five).
Equal sets are one node first. Shingles are ordered by rarity. If two sets have Jaccard
0.8 or more, then of any set that spends `n - ceil(0.8 n) + 1` units of its first
shingles the partner shares a token or a combination: a rare shingle counts one unit and
is indexed by itself; frequent shingles are dealt into classes (by hash, as many as an
eighth of the size band), each class counts one unit less than its shingles, for which
the prefix is extended, and is indexed by its 2-shingle combinations. Two sets meet at a
size band both use, so combinations also bear the length bound.

Nodes that share a key are linked through verified pairs. First each node is compared with
the one list leader that it shares most keys with, after a positional bound. Nodes that are
then still outside a list's largest component are compared with the members of the other
components, and nothing else: in lists of up to HOT_LIST nodes by a join, in longer ones
block by block inside tasks, which give rows for near pairs only. A long list of combinations
leaves out members that can only link through a rare shingle, as they meet in that shingle's
list: with the same template and different fillings nothing is left. Blocks keep to a size
band, and only blocks of bands that can link are compared. What decides that a pair
is near is a parity sketch of each set: its bits differ in at most as many places as the sets
do, so a pair with more differences than 0.8 allows is out for certain; the rest are verified
on the whole sets. In the first round over long lists each node brings forward its nearest
NEAREST of each block of one list, the longest in which it is apart, which joins up groups of
near copies; the second round takes all lists and brings forward all that are still apart, so no link between components is left out.

Shingles and sets are held as 64-bit hashes. The table of frequent shingles (found by
tasks that meet them twice) is bounded and just sets the order, which any order would do
right; lists of any length are led by a pre-aggregated minimum and split by block. Defined
cases: texts without words have empty sets and are their own component; very long texts
are scanned whole, as one slice; repeated rows and ties are equal sets, one node; a null
doc_id never names a component unless it is alone (then null); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, write_table
from . import bits as bitmaps
from .components import components
from .text import mix, scan_words, shingles

WORDS = 5
#: lists of more nodes are compared block by block; partners a node brings forward in the first round; bytes of sketches in a block
HOT_LIST, NEAREST, BLOCK_BYTES = 64, 2, 1 << 17
#: Jaccard of 4 / 5
NUM, DEN = 4, 5
FREQUENT = 32
MOST_FREQUENT = 1 << 20
#: step of the size bands that blocks keep to, and how many bands apart linked sizes can be
BLOCK_BAND, BANDS_APART = 1.05, 5
#: flags of shingles met, a byte each, in a task
MET_BITS = 1 << 24


def sets_of(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    for i, j, w in scan_words(batch.column("text")):
        for d in range(j - i):
            yield i + d, np.unique(shingles(w.hashes[w.first[d] : w.first[d + 1]], words))


def sketch(s: np.ndarray) -> bytes:
    """Parity sketch: a bit for each residue of the shingle hashes, 4 to 8 times as many bits as shingles; set where an odd number fall."""
    bits = 1 << max(8, (len(s) - 1).bit_length() + 2)
    at = ((s >> np.uint64(17)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded to a smaller width: still parities of the same set."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def node_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(mix(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].astype(np.int64)) if len(s) else 0


def _met_twice(words: int):
    """(shingle, documents) of shingles that a task meets twice, by a bitmap of those met; a few met once may slip in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again, size = np.zeros(MET_BITS, dtype=bool), [], 0

        def found():
            h, n = np.unique(np.concatenate(again) if again else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64) + 1)], ["h", "n"])

        for b in batches:
            for _, s in sets_of(b, words):
                at = (s & np.uint64(MET_BITS - 1)).astype(np.int64)
                again.append(s[seen[at]])
                seen[at] = True
                size += len(s)
            if size > MET_BITS // 4:
                yield found()
                seen[:] = False
                again, size = [], 0
        yield found()

    return run


def frequent_shingles(docs: DataFrame, words: int, least: int = FREQUENT, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and document counts of frequent shingles."""
    got = docs.select("text").mapInArrow(_met_twice(words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    top = got.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def band_of(n: int) -> int:
    """Size bands; sizes that can link are in the same or the next one."""
    return int(np.floor(np.log(n) / np.log(DEN / NUM) + 1e-9))


def classes_in(band: int) -> int:
    """Number of classes of frequent shingles in a size band: an eighth of its least size."""
    return max(1, int((DEN / NUM) ** band) // 8)


def prefix_keys(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of single rare shingles, keys of combinations of frequent ones) of a set of four or more."""
    n = len(s)
    need = n - -(-NUM * n // DEN) + 1
    fh, fn = frequent
    at = np.minimum(np.searchsorted(fh, s), len(fh) - 1) if len(fh) else None
    often = fh[at] == s if at is not None else np.zeros(n, bool)
    rare = s[~often]
    if len(rare) >= need:
        return rare[:need], np.zeros(0, np.uint64)
    f = s[often][np.argsort(fn[at[often]], kind="stable")]
    combos = []
    for band in (band_of(n), band_of(n) + 1):
        cls = (mix(f) % np.uint64(classes_in(band))).astype(np.int64)
        later = np.ones(len(f), bool)
        later[np.unique(cls, return_index=True)[1]] = False
        units = len(rare) + np.cumsum(later)
        m = int(np.searchsorted(units, need)) + 1
        order = np.argsort(cls[:m], kind="stable")
        c, x = cls[:m][order], f[:m][order]
        for d in range(1, len(x)):
            same = c[:-d] == c[d:]
            if not same.any():
                break
            combos.append(mix(x[:-d][same] * np.uint64(0x9E3779B97F4A7C15) + x[d:][same] + np.uint64(band)))
    return rare, np.concatenate(combos) if combos else np.zeros(0, np.uint64)


def _index(frequent, words: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            rows = b.num_rows
            node, size = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            lists: list[list[np.ndarray]] = [[], []]
            lens = np.zeros((2, rows), np.int64)
            sketches: list[bytes | None] = [None] * rows
            for i, s in sets_of(b, words):
                node[i], size[i] = node_of(s), len(s)
                if len(s) > NUM - 1 and node[i] not in met:
                    if len(met) < 1_000_000:
                        met.add(int(node[i]))
                    sketches[i] = sketch(s)
                    for k, keys in enumerate(prefix_keys(s, frequent.value)):
                        lists[k].append(keys)
                        lens[k, i] = len(keys)
            arrays = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens[k])]).astype(np.int32)), pa.array(np.concatenate(lists[k]).view(np.int64) if lists[k] else np.zeros(0, np.int64))) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(node), pa.array(size), *arrays, pa.array(sketches, pa.binary())], [*keep, "node", "n", "singles", "combos", "sketch"])

    return run


def _emit_sets(wanted, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            nodes, sets = [], []
            for _, s in sets_of(b, words):
                if len(s) > NUM - 1:
                    k = node_of(s)
                    if k not in met and bitmaps.held(wanted.value, np.array([k], np.int64).view(np.uint64))[0]:
                        if len(met) < 1_000_000:
                            met.add(k)
                        nodes.append(k)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets link."""
    d = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).hint("shuffle_hash"), "a")
    d = d.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).hint("shuffle_hash"), "b")
    return d.select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long")


def fits(x, y):
    """Length bound."""
    return DEN * F.least(x, y) >= NUM * F.greatest(x, y)


def shared_keys(nodes: DataFrame) -> DataFrame:
    """key, single, node, n, leader, leader_n, size, least (smallest n) for every entry of a list with two nodes or more.

    A list may be as long as a group of copies: leaders are pre-aggregated and joined.
    """
    entries = nodes.select(F.explode("singles").alias("key"), "node", "n", F.lit(True).alias("single")).unionByName(nodes.select(F.explode("combos").alias("key"), "node", "n", F.lit(False).alias("single")))
    lead = entries.groupBy("key", "single").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1")
    lead = write_table(lead.select("key", "single", F.col("lead.node").alias("leader"), F.col("lead.n").alias("leader_n"), "size", "least"), "leaders")
    lists = write_table(entries.join(lead.hint("merge"), ["key", "single"]), "lists")
    drop_table(lead)
    return lists


def link_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    rows = labelled_rows(docs, ["doc_id"], words)
    names = write_table(rows.groupBy("label").agg(F.min("doc_id").alias("least")), "names")
    out = rows.join(names.hint("merge"), "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def labelled_rows(docs: DataFrame, keep: list[str], words: int = WORDS) -> DataFrame:
    """The kept columns, n (shingles) and label (of the component; null without shingles) of every row of docs (also: text); written."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(*keep, "text")
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    frequent = sc.broadcast(frequent_shingles(docs, words))
    index = write_table(docs.mapInArrow(_index(frequent, words, keep), f"{kinds}, node long, n long, singles array<long>, combos array<long>, sketch binary"), "index")
    nodes = write_table(index.filter("sketch is not null").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "singles", "combos", "sketch")]), "nodes")
    lists = shared_keys(nodes)
    info = nodes.select("node", "n", F.size("singles").alias("p"), (F.size("combos") > 0).alias("more"), "sketch")
    info = write_table(info.join(lists.select("node").distinct().hint("merge"), "node", "left_semi"), "info")
    drop_table(nodes)
    led = lists.filter(fits(F.col("n"), F.col("leader_n")) & (F.col("node") != F.col("leader"))).groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count(F.when(F.col("single"), 1)).alias("v"), F.count("*").alias("votes"))
    best = may_link(led, info).groupBy("b").agg(F.max(F.struct("votes", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    best = write_table(best, "leader_pairs")
    hot = lists.filter(F.col("size") > HOT_LIST).select("key", "single", "node", "least").join(info.select("node", "n", "p", "sketch").hint("merge"), "node")
    hot = write_table(hot.filter(can_meet_here(F.col("n"), F.col("p"), F.col("single"), F.col("least"))).drop("least"), "hot_lists")
    sets = sets_for(docs, [best.select(F.col("a").alias("h")), best.select(F.col("b").alias("h")), hot.select(F.col("node").alias("h"))], words)
    links = write_table(verified(best, sets), "leader_links")
    labels = components(links)
    nearest = write_table(near_in_blocks(hot, labels, NEAREST), "nearest_pairs")
    more = write_table(verified(nearest, sets), "nearest_links")
    drop_table(sets)
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    apart = near_in_blocks(hot, labels, 0).unionByName(near(_apart(lists.filter(F.col("size") <= HOT_LIST), labels), info)).distinct()
    apart = write_table(apart, "apart_pairs")
    drop_table(hot, lists)
    sets = sets_for(docs, [apart.select(F.col("a").alias("h")), apart.select(F.col("b").alias("h"))], words)
    last = write_table(verified(apart, sets), "later_links")
    drop_table(sets)
    if not last.isEmpty():
        labels = components(links.unionByName(last))
    rows = index.select(*keep, "node", "n").join(labels.hint("merge"), "node", "left")
    out = write_table(rows.select(*keep, "n", F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("label")), "labelled")
    drop_table(index, info)
    return out


def sets_for(docs: DataFrame, nodes: list[DataFrame], words: int) -> DataFrame:
    """node, shingles of the wanted nodes (columns h), made again from the texts; a bitmap lets others pass rarely."""
    wanted = nodes[0]
    for n in nodes[1:]:
        wanted = wanted.unionByName(n)
    bits = docs.sparkSession.sparkContext.broadcast(bitmaps.bitmap(wanted))
    sets = docs.select("text").mapInArrow(_emit_sets(bits, words), "node long, shingles binary")
    return write_table(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def allowed(n_a, n_b):
    """Most elements in which two linked sets of these sizes differ."""
    return (DEN - NUM) * (n_a + n_b) // (DEN + NUM)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        most = allowed(b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
        keep = np.zeros(b.num_rows, bool)
        for i, (x, y) in enumerate(zip(b.column("sk_a"), b.column("sk_b"), strict=True)):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            w = min(len(p), len(q))
            keep[i] = np.bitwise_count(folded(p, w) ^ folded(q, w)).sum() <= most[i]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))


def near(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches allow a link."""
    for x in "ab":
        pairs = pairs.join(info.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sk_{x}")).hint("merge"), x)
    return pairs.select("a", "b", "n_a", "n_b", "sk_a", "sk_b").mapInArrow(_near, "a long, b long")


def _by_width(side: pa.StructArray) -> list[tuple[np.ndarray, ...]]:
    """node, n, own, sketches and most (what a member can share here with a partner) of a block's members, by the width of their sketches."""
    node, n, own, most = (side.field(c).to_numpy() for c in ("node", "n", "own", "most"))
    raw = side.field("sketch").to_pylist()
    width = np.array([len(x) for x in raw])
    out = []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out.append((node[at], n[at], own[at], np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), -1), most[at]))
    return out


def _close(nearest: int):
    """Near pairs of each pair of blocks that are in different components: for each of the first block the nearest so many, or all (0)."""

    def compared(x, y) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        w = min(x[3].shape[1], y[3].shape[1])
        mx, my = folded(x[3], w), folded(y[3], w)
        step = max(1, (1 << 20) // my.size)
        for i in range(0, len(mx), step):
            n_x, n_y = x[1][i : i + step, None], y[1][None]
            apart = np.bitwise_count(mx[i : i + step, None] ^ my[None]).sum(axis=2, dtype=np.int64)
            ok = (apart <= allowed(n_x, n_y)) & (DEN * np.minimum(n_x, n_y) >= NUM * np.maximum(n_x, n_y)) & (x[2][i : i + step, None] != y[2][None])
            ok &= (NUM + DEN) * np.minimum(x[4][i : i + step, None], y[4][None]) >= NUM * (n_x + n_y)
            if nearest and ok.any():
                apart[~ok] = np.iinfo(np.int64).max
                first = np.argsort(apart, axis=1, kind="stable")[:, :nearest]
                best = np.zeros_like(ok)
                np.put_along_axis(best, first, True, axis=1)
                ok &= best
            r, c = np.nonzero(ok)
            yield x[0][i + r], y[0][c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for odd, others in zip(b.column("odd"), b.column("others"), strict=True):
                found = [p for x in _by_width(odd.values) for y in _by_width(others.values) for p in compared(x, y) if len(p[0])]
                if found:
                    p, q = (np.concatenate(z) for z in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    return run


def can_meet_here(n, p, single, least):
    """Whether a member of a list can link there: in a list of combinations a partner that shares none of its p rare shingles, at least 0.8 as large and no smaller than the list's least."""
    partner = F.greatest(-F.floor(-F.lit(NUM) * n / DEN), least)
    return single | ((NUM + DEN) * (n - p) >= NUM * (n + partner))


def near_in_blocks(hot: DataFrame, labels: DataFrame, nearest: int) -> DataFrame:
    """Near pairs (a, b) of long lists: members outside a list's largest component against the members of other components.

    hot: key, single, node, n, p (rare shingles), sketch. Members are dealt into blocks of about
    BLOCK_BYTES by size band and hash; each pair of blocks of bands that can link is one row,
    and these rows spread over the tasks.
    """
    odd, others = blocks_to_compare(hot.withColumn("once", F.lit(True)) if nearest else hot, labels)
    return odd.join(others.hint("merge"), ["key", "single", "ob", "obb", "xb", "xbb"]).select("odd", "others").mapInArrow(_close(nearest), "a long, b long").distinct()


def blocks_to_compare(hot: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(odd, others): blocks by key, single, ob and obb, xb and xbb (number and band of either), a row for each partner.

    Where hot has a column once, a member is odd in one list only, the longest in which it is outside the largest component.
    """
    once, hot = "once" in hot.columns, hot.drop("once")
    key = ["key", "single"]
    d = hot.withColumns({"most": F.when(F.col("single"), F.col("n")).otherwise(F.col("n") - F.col("p")), "band": F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BLOCK_BAND))).cast("int")}).drop("p")
    d = d.join(labels.select("node", F.col("label").alias("own")).hint("merge"), "node", "left").withColumn("own", F.coalesce("own", "node"))
    d = write_table(d, "hot_members")
    parts = write_table(d.groupBy(*key, "own", "band").agg(F.sum(F.octet_length("sketch")).alias("bytes"), F.count("*").alias("c"), F.max("most").alias("most"), F.min("n").alias("n")), "hot_parts")
    whole = parts.groupBy(*key, "own").agg(F.sum("c").alias("c"))
    main = whole.groupBy(*key).agg(F.max(F.struct("c", "own")).alias("main"), F.count("*").alias("k"), F.sum("c").alias("size")).filter("k > 1").select(*key, F.col("main.own").alias("main"), "size")
    asking = d.select(*key, "node", "own", "band", F.octet_length("sketch").alias("asked")).join(main.hint("merge"), key).filter("own <> main")
    if once:
        asking = asking.groupBy("node").agg(F.max(F.struct("size", *key, "band", "asked")).alias("x")).select("node", "x.*")
    asking = write_table(asking.select(*key, "node", "band", "asked"), "hot_asking")
    main = main.drop("size")
    blocks = lambda size: F.ceil(size / F.lit(BLOCK_BYTES)).cast("int")
    of_band = parts.join(main.hint("merge"), key).groupBy(*key, "main", "band").agg(blocks(F.sum("bytes")).alias("blocks"), F.max("most").alias("most"), F.min("n").alias("n"))
    asked = asking.groupBy(*key, "band").agg(blocks(F.sum("asked")).alias("odd_blocks"))
    of_band = of_band.join(asked.hint("merge"), [*key, "band"], "left").withColumn("odd_blocks", F.coalesce("odd_blocks", F.lit(0)))
    of_list = write_table(of_band.groupBy(*key, "main").agg(F.collect_list(F.struct("band", "odd_blocks", "blocks", "most", "n")).alias("bands")), "open_lists")
    d = d.join(of_list.hint("merge"), key)
    d = d.withColumn("mine", F.filter("bands", lambda b: b["band"] == F.col("band"))[0])
    enough = lambda b: (NUM + DEN) * F.least(b["most"], F.col("mine.most")) >= NUM * (b["n"] + F.col("mine.n"))
    near = F.filter("bands", lambda b: (F.abs(b["band"] - F.col("band")) <= BANDS_APART) & enough(b))
    d = d.withColumns({"odd_blocks": F.col("mine.odd_blocks"), "blocks": F.col("mine.blocks"), "near": near}).drop("bands", "mine")
    member = F.struct("node", "n", "own", "most", "sketch")
    # members of the main component may be asked too before they are filtered out, and have no odd block
    at = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")

    def partners(g: DataFrame, count: str, block: str, band: str) -> DataFrame:
        g = g.select("*", F.explode("near").alias("x")).filter(F.col(f"x.{count}") > 0)
        return g.select("*", F.explode(F.sequence(F.lit(0), F.col(f"x.{count}") - 1)).alias(block), F.col("x.band").alias(band)).drop("near", "x")

    odd = d.filter("own <> main")
    if once:
        odd = odd.join(asking.select(*key, "node").hint("merge"), [*key, "node"], "left_semi")
    odd = odd.groupBy(*key, at("odd_blocks").alias("ob"), F.col("band").alias("obb")).agg(F.collect_list(member).alias("odd"), F.first("near").alias("near"))
    others = d.groupBy(*key, at("blocks").alias("xb"), F.col("band").alias("xbb")).agg(F.collect_list(member).alias("others"), F.first("near").alias("near"))
    return partners(odd, "blocks", "xb", "xbb"), partners(others, "odd_blocks", "ob", "obb")


def may_link(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Positional bound: pairs (a, b, v: shared single keys) that can still reach the overlap they need.

    A set whose prefix has single shingles only (p of them) shares with the partner these v
    and at most its other n - p, if its prefix ends first in the order; prefixes that reach
    the frequent shingles end later and hold all rare ones.
    """
    d = pairs
    for x in "ab":
        d = d.join(info.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "p", "more")]).hint("merge"), x)
    left_a, left_b = F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")
    most = F.when(F.col("more_a") & F.col("more_b"), F.least(left_a, left_b)).when(F.col("more_a"), left_b).when(F.col("more_b"), left_a).otherwise(F.greatest(left_a, left_b))
    enough = (NUM + DEN) * (F.col("v") + most) >= NUM * (F.col("n_a") + F.col("n_b"))
    return d.filter(enough).select(*pairs.columns)


def _apart(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of fitting size that share one of these lists but no component."""
    label = labels.withColumnRenamed("label", "own")
    d = lists.join(label.hint("merge"), "node", "left").withColumn("own", F.coalesce("own", "node"))
    d = d.join(label.select(F.col("node").alias("leader"), F.col("own").alias("led")).hint("merge"), "leader", "left").withColumn("led", F.coalesce("led", "leader"))
    d = write_table(d.select("key", "single", "node", "n", "own", "led"), "members")
    odd = d.filter("own <> led").select("key", "single", F.col("node").alias("x"), F.col("n").alias("x_n"), F.col("own").alias("x_own"))
    met = odd.join(d.hint("merge"), ["key", "single"]).filter((F.col("own") != F.col("x_own")) & fits(F.col("n"), F.col("x_n")) & ((F.col("own") == F.col("led")) | (F.col("x") < F.col("node"))))
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Contract query: components of all documents."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
