"""Language-model scoring by deleted interpolation.

Tokens are lower-cased words and one end per text. Counts of all training tokens and of all
pairs (previous word, word) are gathered, exactly; both grow with the corpus. A token's
probability is a mixture of the bigram, unigram and uniform estimates

    p(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1)

over N training tokens of V words and one unseen word. Its weights depend on how often the
context v was seen (a bucket per power of two), and are learned by expectation-maximisation:
counts come from most of the training documents, and the likelihood of the pairs of the
others (the deleted part) is raised. At the end all training counts are used; a context that
was never seen has no bigram estimate.

The most frequent HEAD words are broadcast. Pairs are counted in buckets of about BUCKET_TOKENS
tokens, whose number grows with the corpus: a task packs the pairs of a slice of documents by
bucket, and one group of packed pairs holds all that is known of its pairs and of their rare
word. Pairs that slices hold often (at most FREQUENT) are counted within tasks and broadcast,
so no pair left to the buckets makes up more than about 1/FREQUENT of the tokens. Only pairs of
two rare words need a join. None of these sizes changes a result. Identity is by 64-bit hashes
of words and pairs, and of doc_id and text together by two of them. Slices are numbered by
task, so docs should be a table that reads alike when a task is run again, as files do. Defined
cases: a null text is empty (just the end); a null doc_id trains; repeated rows are scored
each; an empty table gives no rows, no training documents a uniform model; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .text import mix, scan_words

HEAD_BITS = 18
HEAD = 1 << HEAD_BITS
FREQUENT = 1 << 18
CLASSES = 2048
SLICE_TOKENS = 1_000_000
OFTEN = 4
SLICE_BITS = 32
BUCKET_TOKENS = 1 << 21
MOST_PARTITIONS = 20_000
RECORDS, COUNTS, PAIRS, DOCUMENTS = range(4)
BLOBS = "bucket int, kind int, slice long, blob binary"
END = np.uint64(0)
EM_ROUNDS = 10
BUCKETS = 48


def with_end(w) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice with an end after each document, and where each document ends (index of its end)."""
    ends = w.first[1:] + np.arange(len(w.first) - 1)
    out = np.zeros(len(w.hashes) + len(ends), dtype=np.uint64)
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner] = np.where(w.hashes == END, np.uint64(1), w.hashes)
    return out, ends


def _merge(h: list, c: list, a: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate(h), return_inverse=True)
    return u, *(np.bincount(at, weights=np.concatenate(n), minlength=len(u)).astype(np.int64) for n in (c, a))


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, c (all) and a (without the deleted part)."""
    hs, cs, ns, size = [], [], [], 0
    for b in batches:
        deleted = b.column("deleted").to_numpy(zero_copy_only=False).astype(bool)
        for i, j, w in scan_words(b.column("text")):
            t, ends = with_end(w)
            u, at = np.unique(t, return_inverse=True)
            hs.append(u)
            cs.append(np.bincount(at, minlength=len(u)))
            ns.append(np.bincount(at[~np.repeat(deleted[i:j], lengths(ends))], minlength=len(u)))
            size += len(u)
            if size > 4_000_000:
                u, c, n = _merge(hs, cs, ns)
                if len(u) > 2_000_000:
                    yield _counted(u, c, n)
                    hs, cs, ns, size = [], [], [], 0
                else:
                    hs, cs, ns, size = [u], [c], [n], len(u)
    if hs:
        yield _counted(*_merge(hs, cs, ns))


def lengths(ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[-1], ends]))


def _counted(u: np.ndarray, c: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64)), pa.array(a.astype(np.int64))], ["h", "c", "a"])


def code_of(h):
    """The code of a word that isn't in the head: its hash, out of the range of head numbers."""
    return F.when((h >= 0) & (h < HEAD), h + HEAD).otherwise(h)


def codes(head: tuple, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes, index into them per token, hashes of the distinct): a head word's code is its number in the head."""
    u, back = np.unique(h, return_inverse=True)
    code = np.where(u < HEAD, u + np.uint64(HEAD), u).view(np.int64)
    head_h = head[0]
    if len(head_h):
        at = np.minimum(np.searchsorted(head_h, u), len(head_h) - 1)
        code = np.where(head_h[at] == u, at, code)
    return code, back, u


def _before(back: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each token the one before it; a document's first comes after an end."""
    out = np.concatenate([back[:1], back[:-1]])
    out[np.concatenate([[0], ends[:-1] + 1])] = back[ends]
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 1, 4 or 8 bytes an entry as compressed byte planes."""
    sizes = np.array([len(arrays), *[x for a in arrays for x in (len(a), a.itemsize)]], dtype=np.int64)
    raw = sizes.tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    k = int.from_bytes(raw[:8], "little")
    at, out = 8 + 16 * k, []
    for n, width in np.frombuffer(raw, np.int64, 2 * k, 8).reshape(k, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view({1: np.uint8, 4: np.uint32, 8: np.int64}[width]).reshape(n))
        at += n * width
    return out


def in_head(code: np.ndarray) -> np.ndarray:
    return (code >= 0) & (code < HEAD)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for two head words; -1 where one of them isn't in the head."""
    return np.where(in_head(v) & in_head(w), (v << HEAD_BITS) | w, -1)


def found(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted keys, and whether each is there."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return at, keys[at] == key


def _often(head):
    """key, n: pairs of head words that a slice of SLICE_TOKENS tokens holds OFTEN times or more."""

    def counted(waiting: list) -> pa.RecordBatch:
        t, v = (np.concatenate(x) for x in zip(*waiting, strict=True))
        code, back, u = codes(head.value, t)
        before = code[np.searchsorted(u, v)]
        key, n = np.unique(pair_keys(before, code[back]), return_counts=True)
        keep = (key >= 0) & (n >= OFTEN)
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(n[keep].astype(np.int64))], ["key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for b in batches:
            for _, _, w in scan_words(b.column("text")):
                t, ends = with_end(w)
                waiting.append((t, _before(t, ends)))
                size += len(t)
                if size > SLICE_TOKENS:
                    yield counted(waiting)
                    waiting, size = [], 0
        if waiting:
            yield counted(waiting)

    return run


def bucket_numbers(v: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    """Where a pair is counted: at its rare word (the first, if both are), else at the hash of both."""
    at = np.where(~in_head(v), v, np.where(~in_head(w), w, (v << HEAD_BITS) | w))
    return (mix(at.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "slice", "blob"])


def _groups(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct number with the rows that have it, in their order."""
    order = np.argsort(numbers, kind="stable")
    edges = np.flatnonzero(np.diff(numbers[order])) + 1
    for rows in np.split(order, edges) if len(order) else []:
        yield int(numbers[rows[0]]), rows


def _pairs(head, often, buckets: int):
    """Pairs by bucket, in blobs.

    PAIRS: v, w, and how often in the counted and the deleted part, of a slice of documents;
    their answers come back in this order. DOCUMENTS: the same slice's dh and th, and by
    bucket, in that order, the documents of each pair. RECORDS: pairs of two rare words, with
    their documents: v, w, document, times, dh, th, part. Pairs that are often met come last,
    as counts of the whole task in negative buckets.
    """

    def packed(waiting: list, seen: np.ndarray, no: int) -> pa.RecordBatch:
        t, tokens, part, dh, th = (np.concatenate(x) for x in zip(*waiting, strict=True))
        code, back, _ = codes(head.value, t)
        k, pair = np.unique(_before(back, np.cumsum(tokens) - 1) * len(code) + back, return_inverse=True)
        v, w = code[k // len(code)], code[k % len(code)]
        at, hit = found(often.value, pair_keys(v, w))
        doc = np.repeat(np.arange(len(part)), tokens)
        ab = [np.bincount(pair[part[doc] == p], minlength=len(k)) for p in (0, 1)]
        for p in (0, 1):
            seen[p][at[hit]] += ab[p][hit]
        apart = ~in_head(v) & ~in_head(w)
        bucket = bucket_numbers(v, w, buckets)
        near = np.flatnonzero(~hit & ~apart)
        near = near[np.argsort(bucket[near], kind="stable")]
        out = [(b, PAIRS, no, pack(v[near[rows]], w[near[rows]], *(x[near[rows]].astype(np.uint32) for x in ab))) for b, rows in _groups(bucket[near])]
        rank = np.full(len(k), -1)
        rank[near] = np.arange(len(near))
        rank = rank[pair]
        r, times = np.unique(rank[rank >= 0] * len(part) + doc[rank >= 0], return_counts=True)
        met, size = np.unique(bucket[near], return_counts=True)
        step = np.diff(r // len(part), prepend=0).astype(np.uint32)
        out.append((int(mix(np.array([no], np.uint64))[0] % np.uint64(buckets)), DOCUMENTS, no, pack(met, size, step, (r % len(part)).astype(np.uint32), times.astype(np.uint32), dh, th)))
        far = apart[pair]
        k, times = np.unique(pair[far] * len(part) + doc[far], return_counts=True)
        pair, doc = k // len(part), k % len(part)
        for b, rows in _groups(bucket[pair]):
            own, local = np.unique(doc[rows], return_inverse=True)
            out.append((b, RECORDS, no, pack(v[pair[rows]], w[pair[rows]], local.astype(np.uint32), times[rows].astype(np.uint32), dh[own], th[own], part[own])))
        return _blobs(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, len(often.value)), np.int64)
        no = TaskContext.get().partitionId() << SLICE_BITS
        waiting, size = [], 0
        for b in batches:
            held, deleted = (b.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("held_out", "deleted"))
            part = np.where(held, 2, deleted).astype(np.uint8)
            dh, th = (b.column(x).to_numpy() for x in ("dh", "th"))
            for i, j, w in scan_words(b.column("text")):
                t, ends = with_end(w)
                waiting.append((t, lengths(ends), part[i:j], dh[i:j], th[i:j]))
                size += len(t)
                if size > SLICE_TOKENS:
                    yield packed(waiting, seen, no)
                    waiting, size, no = [], 0, no + 1
        if waiting:
            yield packed(waiting, seen, no)
        met = np.flatnonzero(seen.any(axis=0))
        out = [(-1 - c, RECORDS, None, pack(met[rows], seen[0][met[rows]], seen[1][met[rows]])) for c, rows in _groups(met % max(1, buckets // 8))]
        yield _blobs(out)

    return run


def _rare_counts(buckets: int):
    """Counts of words outside the head, as blobs of kind COUNTS in the bucket of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, c, a = (b.column(x).to_numpy() for x in ("code", "c", "a"))
            yield _blobs([(k, COUNTS, None, pack(code[rows], c[rows], a[rows])) for k, rows in _groups(bucket_numbers(code, code, buckets))])

    return run


FOUND = "slice long, bucket long, pairs binary, documents binary, em binary, key long, dh long, th long, n long, w long, c long, cv long, a long, av long, b long"
FOUND_TYPES = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in FOUND.split(", ")])


def _found(**columns) -> pa.Table:
    n = len(next(iter(columns.values())))
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in FOUND_TYPES], schema=FOUND_TYPES)


def _count(head, often):
    """Counts the pairs of one bucket over the whole corpus.

    pairs: of each slice c, cv, cw and whether w is rare, in the slice's order; documents: as
    they came; em: a, av, aw, b of the pairs met in the deleted part. A pair of two rare words
    has its w counted in another bucket, so that it comes as rows of their own, one a
    document, to be joined (b only in the first). Often met pairs: key, a, b.
    """

    def run(group: pa.Table) -> pa.Table:
        _, head_c, head_a = head.value
        blobs = {k: [unpack(x.as_py()) for x, kind in zip(group.column("blob"), group.column("kind").to_pylist(), strict=True) if kind == k] for k in (RECORDS, COUNTS, PAIRS)}
        if group.column("bucket")[0].as_py() < 0:
            at, a, b = (np.concatenate(x) for x in zip(*blobs[RECORDS], strict=True))
            at, back = np.unique(at, return_inverse=True)
            a, b = (np.bincount(back, weights=x).astype(np.int64) for x in (a, b))
            key, e = often.value[at], b > 0
            em = pack(a[e], head_a[key[e] >> HEAD_BITS], head_a[key[e] & (HEAD - 1)], b[e])
            return pa.concat_tables([_found(em=[em]), _found(key=key, a=a, b=b)])
        rare, rare_c, rare_a = (np.concatenate(x) for x in zip(*blobs[COUNTS], strict=True)) if blobs[COUNTS] else (np.zeros(0, np.int64),) * 3
        order = np.argsort(rare)
        rare, rare_c, rare_a = rare[order], rare_c[order], rare_a[order]

        def counts(code: np.ndarray, of_head: np.ndarray, of_rare: np.ndarray) -> np.ndarray:
            out = np.zeros(len(code), np.int64)
            known = in_head(code)
            out[known] = of_head[code[known]]
            at, hit = found(rare, code)
            hit &= ~known
            out[hit] = of_rare[at[hit]]
            return out

        kinds, slices = (group.column(x).to_pylist() for x in ("kind", "slice"))
        through = [i for i, x in enumerate(kinds) if x == DOCUMENTS]
        out = [_found(slice=[slices[i] for i in through], documents=[group.column("blob")[i].as_py() for i in through])]
        if blobs[PAIRS]:
            edges = np.cumsum([len(x[0]) for x in blobs[PAIRS]])[:-1]
            v, w, a, b = (np.concatenate(x) for x in zip(*blobs[PAIRS], strict=True))
            first, pair = distinct_pairs(v, w)
            a, b = (np.bincount(pair, weights=x, minlength=len(first)).astype(np.int64) for x in (a, b))
            v, w = v[first], w[first]
            cv, av, cw, aw = (counts(x, *n) for x in (v, w) for n in ((head_c, rare_c), (head_a, rare_a)))
            e, tail = b > 0, (~in_head(w)).astype(np.uint8)
            answers = [pack((a + b)[p], cv[p], cw[p], tail[p]) for p in np.split(pair, edges)]
            bucket = group.column("bucket")[0].as_py()
            out.append(_found(slice=[n for n, x in zip(slices, kinds, strict=True) if x == PAIRS], bucket=[bucket] * len(answers), pairs=answers))
            out.append(_found(em=[pack(a[e], av[e], aw[e], b[e])]))
        if blobs[RECORDS]:
            v, w, doc, times, dh, th, part = zip(*blobs[RECORDS], strict=True)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in dh])])
            doc = np.concatenate([x.astype(np.int64) + n for x, n in zip(doc, starts, strict=False)])
            v, w, times, dh, th, part = (np.concatenate(x) for x in (v, w, times, dh, th, part))
            first, pair = distinct_pairs(v, w)
            a, b = (np.bincount(pair, weights=times * (part[doc] == p), minlength=len(first)).astype(np.int64) for p in (0, 1))
            cv, av = (counts(v[first], *n) for n in ((head_c, rare_c), (head_a, rare_a)))
            once = np.zeros(len(pair), np.int64)
            once[first] = b
            out.append(_found(dh=dh[doc], th=th[doc], n=times.astype(np.int64), w=w, c=(a + b)[pair], cv=cv[pair], a=a[pair], av=av[pair], b=once))
        return pa.concat_tables(out)

    return run


def distinct_pairs(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair is first met, and the number of each row's pair."""
    return np.unique(mix(v.view(np.uint64)) * np.uint64(3) + w.view(np.uint64), return_index=True, return_inverse=True)[1:]


def _deleted_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("em"):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in unpack(x.as_py())], ["a", "ca", "wa", "b"])


def log_p_of(weights: list[list[float]], n: int, live: int, c: np.ndarray, cv: np.ndarray, cw: np.ndarray) -> np.ndarray:
    """log_p of whole arrays."""
    if n == 0:
        return np.full(len(c), -np.log10(live))
    lam = np.array(weights)[np.minimum(BUCKETS - 1, np.floor(np.log2(cv + 1.0)).astype(np.int64))]
    seen = lam[:, 0] * c / np.maximum(cv, 1) + lam[:, 1] * cw / n + lam[:, 2] / live
    return np.log10(np.where(cv > 0, seen, 0.5 * cw / n + 0.5 / live))


def _pair_logs(weights: list[list[float]], n: int, live: int):
    """Sums of a slice's pairs for each of its documents: the score, and of rare words the logarithms of base and how many were trained on."""

    def run(group: pa.Table) -> pa.Table:
        answers = {b: x for b, x in zip(group.column("bucket").to_pylist(), group.column("pairs"), strict=True) if x.is_valid}
        met, size, step, doc, times, dh, th = unpack(next(x for x in group.column("documents") if x.is_valid).as_py())
        parts = [unpack(answers[b].as_py()) for b in met.tolist()] or [[np.zeros(0, np.int64)] * 4]
        c, cv, cw, rare = (np.concatenate(x) for x in zip(*parts, strict=True))
        assert len(c) == size.sum()
        pair = np.cumsum(step.astype(np.int64))
        known = (rare > 0) & (cw > 0)
        sums = [log_p_of(weights, n, live, c, cv, cw), np.where(known, np.log10(cw + 1.0), 0.0), known.astype(float)]
        out = [np.bincount(doc, weights=x[pair] * times, minlength=len(dh)) for x in sums]
        return pa.table([pa.array(dh), pa.array(th), *(pa.array(x.astype(t)) for x, t in zip(out, (float, float, np.int64), strict=True))], ["dh", "th", "pair_log", "tail_log", "tail_known"])

    return run


def learn_mixture(pairs: DataFrame, classes: int, live: int, rounds: int = EM_ROUNDS) -> list[list[float]]:
    """Weights (bigram, unigram, uniform) per context-frequency bucket, by EM on the deleted counts b; of a small vocabulary."""
    before = pairs.groupBy("before").agg(F.sum("a").alias("ca"))
    after = pairs.groupBy("cls").agg(F.sum("a").alias("wa"))
    n = pairs.agg(F.sum("a").alias("n")).first()["n"] or 0
    # both tables have at most `classes` rows
    return mixture_weights(pairs.filter("b > 0").join(F.broadcast(before), "before").join(F.broadcast(after), "cls"), n, live, rounds)


def mixture_weights(d: DataFrame, n: int, live: int, rounds: int = EM_ROUNDS) -> list[list[float]]:
    """As learn_mixture, of deleted pairs with their counts: a of the pair, ca of the context, wa of the word, b in the deleted part; n: sum of wa over all words."""
    weights = [[1 / 3, 1 / 3, 1 / 3] for _ in range(BUCKETS)]
    if not n:
        return [[0.0, 0.0, 1.0] for _ in range(BUCKETS)]
    p2 = F.when(F.col("ca") > 0, F.col("a") / F.col("ca")).otherwise(F.lit(0.0))
    d = write_table(d.select(bucket_of(F.col("ca")).alias("bucket"), p2.alias("p2"), (F.col("wa") / F.lit(float(n))).alias("p1"), "b").groupBy("bucket", "p2", "p1").agg(F.sum("b").alias("b")), "held_out_pairs")
    for _ in range(rounds):
        parts = [F.get(F.array(*[F.lit(w[k]) for w in weights]), "bucket") * p for k, p in enumerate((F.col("p2"), F.col("p1"), F.lit(1.0 / live)))]
        total = parts[0] + parts[1] + parts[2]
        rows = d.groupBy("bucket").agg(*[F.sum(F.col("b") * p / total).alias(f"s{k}") for k, p in enumerate(parts)]).collect()
        for r in rows:
            s = [r["s0"], r["s1"], r["s2"]]
            weights[r["bucket"]] = [(x + 1e-3) / (sum(s) + 3e-3) for x in s]
    # a bucket that the deleted part never met takes the weights of the next lower one that it met
    met, last = {r["bucket"] for r in rows}, [0.0, 0.5, 0.5]
    for k in range(BUCKETS):
        last = weights[k] = weights[k] if k in met else last
    return weights


def bucket_of(count):
    return F.least(F.lit(BUCKETS - 1), F.length(F.bin(count.cast("long") + 1)) - 1)


def class_table(pairs: DataFrame, weights: list[list[float]], classes: int, live: int) -> np.ndarray:
    """log10 p(w | v) of a whole small vocabulary, from all training counts; classes x classes numbers in memory. score_documents gives the same by joins."""
    got = pairs.select("before", "cls", (F.col("a") + F.col("b")).alias("n")).toArrow()
    c = np.zeros((classes, classes))
    c[got.column("before").to_numpy(), got.column("cls").to_numpy()] = got.column("n").to_numpy()
    ctx, uni = c.sum(axis=1), c.sum(axis=0) / max(1.0, c.sum())
    lam = np.array(weights)[np.minimum(BUCKETS - 1, np.floor(np.log2(ctx + 1)).astype(int))]
    lam[ctx == 0] = [0.0, 0.5, 0.5] if c.sum() else [0.0, 0.0, 1.0]
    c /= np.maximum(1.0, ctx)[:, None]
    c *= lam[:, :1]
    c += lam[:, 1:2] * uni[None, :] + lam[:, 2:3] / live
    return np.log10(c)


def log_p(weights: list[list[float]], n: int, live: int):
    """log10 p(w | v) as a column of c (the pair), cv and cw."""
    seen = F.col("cv") > 0
    lam = [F.get(F.array(*[F.lit(w[k]) for w in weights]), bucket_of(F.col("cv"))) for k in range(3)]
    if n == 0:
        return F.lit(-float(np.log10(live)))
    never = F.lit(0.5) * F.col("cw") / F.lit(float(n)) + F.lit(0.5 / live)
    return F.log10(F.when(seen, lam[0] * F.col("c") / F.col("cv") + lam[1] * F.col("cw") / F.lit(float(n)) + lam[2] / F.lit(float(live))).otherwise(never))


def _score(head, often):
    """Token numbers, and the part of both scores that the broadcast tables give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_c = np.log10(head.value[1] + 1.0)
        keys, lp = often.value
        for b in batches:
            score, base = np.zeros(b.num_rows), np.zeros(b.num_rows)
            n_tokens, n_head = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(2))
            for i, j, w in scan_words(b.column("text")):
                t, ends = with_end(w)
                code, back, _ = codes(head.value, t)
                first = np.concatenate([[0], ends[:-1] + 1])
                at = code[back]
                known = in_head(at)
                logs = np.zeros(len(t))
                logs[known] = log_c[at[known]]
                where, hit = found(keys, pair_keys(_before(at, ends), at))
                score[i:j] = np.add.reduceat(np.where(hit, lp[where], 0.0) if len(lp) else np.zeros(len(t)), first)
                base[i:j] = np.add.reduceat(logs, first)
                n_tokens[i:j] = lengths(ends)
                n_head[i:j] = np.add.reduceat(known.astype(np.int64), first)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("dh"), b.column("th"), b.column("held_out"), pa.array(n_tokens), pa.array(n_head), pa.array(base), pa.array(score)],
                ["doc_id", "dh", "th", "held_out", "n_tokens", "n_head", "base", "score"],
            )

    return run


def head_of(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most `most`: all words above a count that a histogram of counts gives, so nothing is sorted in one task."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 64)
    room, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if r["n"] > room:
            break
        room, least = room - r["n"], r["step"]
    return counts.filter(F.lit(False)) if least is None else counts.filter(step >= least)


def score_documents(docs: DataFrame, held_out, deleted, head_words: int = HEAD, classes: int = CLASSES, frequent_pairs: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from rows that aren't held_out, those of them that are deleted serve EM. Both are boolean columns.

    head_words (at most HEAD) and frequent_pairs bound what is broadcast and change no result; classes has no effect any more.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select("doc_id", F.xxhash64("doc_id").alias("dh"), F.xxhash64("text").alias("th"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.coalesce(deleted, F.lit(False)).alias("deleted"), "text")
    train = texts.filter(~F.col("held_out"))
    counts = write_table(train.select("deleted", "text").mapInArrow(_unigrams, "h long, c long, a long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("a").alias("a")), "unigrams")
    total = counts.agg(F.sum("c").alias("n"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    live = v + 1
    top = head_of(counts, min(head_words, HEAD)).toArrow()
    h, c, a = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy(), top.column("a").to_numpy()
    order = np.argsort(h)
    h, c, a = h[order], c[order], a[order]
    head = sc.broadcast((h, c, a))
    tail = counts if not len(c) else counts.filter(F.col("c") < F.lit(int(c.min())))
    tail = tail.select(code_of(F.col("h")).alias("code"), "c", "a")
    met = write_table(texts.select("text").mapInArrow(_often(head), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "often")
    keys = np.sort(head_of(met, frequent_pairs).select("key").toArrow().column("key").to_numpy())
    often = sc.broadcast(keys)
    buckets = 1 + n // BUCKET_TOKENS
    blobs = texts.select("held_out", "deleted", "dh", "th", "text").mapInArrow(_pairs(head, often, buckets), BLOBS)
    # the estimated size of blobs says nothing; there are as many partitions as buckets, up to a number that Spark handles well
    blobs = blobs.unionByName(tail.mapInArrow(_rare_counts(buckets), BLOBS)).repartition(min(buckets + buckets // 8 + 1, MOST_PARTITIONS), "bucket")
    got = write_table(blobs.groupBy("bucket").applyInArrow(_count(head, often), FOUND), "pairs")
    apart = got.filter("w is not null").join(tail.select(F.col("code").alias("w"), F.col("c").alias("cw"), F.col("a").alias("aw")).hint("merge"), "w", "left")
    apart = write_table(apart.select("dh", "th", "n", "c", "cv", F.coalesce("cw", F.lit(0)).alias("cw"), "a", "av", F.coalesce("aw", F.lit(0)).alias("aw"), "b"), "rare_pairs")
    learn = got.filter("em is not null").select("em").mapInArrow(_deleted_pairs, "a long, ca long, wa long, b long")
    weights = mixture_weights(learn.unionByName(apart.filter("b > 0").select("a", F.col("av").alias("ca"), F.col("aw").alias("wa"), "b")), total["a"] or 0, live)
    own = got.filter("key is not null").select("key", (F.col("a") + F.col("b")).alias("c")).toArrow()
    pair = np.zeros(len(keys), np.int64)
    pair[np.searchsorted(keys, own.column("key").to_numpy())] = own.column("c").to_numpy()
    lp = log_p_of(weights, n, live, pair, c[keys >> HEAD_BITS], c[keys & (HEAD - 1)])
    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, dh long, th long, held_out boolean, n_tokens long, n_head long, base double, score double"
    rows = texts.drop("deleted").mapInArrow(_score(head, sc.broadcast((keys, lp))), schema).withColumn("n", F.lit(1).cast("long"))
    near = got.filter("slice is not null").select("slice", "bucket", "pairs", "documents").repartition(min(buckets + 1, MOST_PARTITIONS), "slice")
    near = near.groupBy("slice").applyInArrow(_pair_logs(weights, n, live), "dh long, th long, pair_log double, tail_log double, tail_known long")
    known = F.col("cw") > 0
    far = apart.select("dh", "th", (F.col("n") * log_p(weights, n, live)).alias("pair_log"), F.when(known, F.col("n") * F.log10(F.col("cw") + 1.0)).alias("tail_log"), F.when(known, F.col("n")).alias("tail_known"))
    flat = ["doc_id", "held_out", "n_tokens", "n_head", "base", "score"]
    sums = ["tail_log", "tail_known", "pair_log"]
    rows = rows.unionByName(near, allowMissingColumns=True).unionByName(far, allowMissingColumns=True)
    g = rows.groupBy("dh", "th").agg(*[F.max(x).alias(x) for x in flat], F.sum("n").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums])
    return g.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.col("tail_known") / F.col("n")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_log") / F.col("n") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("score") + F.col("pair_log") / F.col("n")).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("each"),
    ).drop("each")


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents scored; crc32(doc_id) mod 7 = 2 is held out, = 3 is the deleted part."""
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)), F.lit(0))
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold == 2, fold == 3)
