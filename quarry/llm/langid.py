"""Language identification as multilingual mixture inference.

Byte trigrams (A-Z lower-cased, other ASCII than letters as blanks) are counted per
language over all training texts. A document is a mixture of languages:
expectation-maximisation estimates its language proportions from the trigram
likelihoods. The set of languages is chosen by penalised likelihood: languages join in
the order of their proportions while -2 log L + penalty x log(n) x size falls. The
prediction is the language with the largest proportion in the chosen set, the score that
proportion.

Only text is looked at when predicting. What is collected is a table of languages x
FEATURES counts. Defined cases: a null text or one without a letter is `und` with score
0; repeated rows are predicted each; a null doc_id trains; an empty table gives no rows;
without training texts all is `und`; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import buffers

FEATURES = 1 << 15
PENALTY = 8.0
EM_ROUNDS, EM_CHANGE = 64, 1e-4

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed trigram numbers of one text's bytes, with a blank at both ends."""
    b = np.concatenate([[32], _FOLD[data], [32]]).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        data, offsets = buffers(b.column("text"))
        for i, lang in enumerate(b.column("lang").to_pylist()):
            n = np.bincount(trigrams(data[offsets[i] : offsets[i + 1]]), minlength=FEATURES)
            if lang in sums:
                sums[lang] += n
            else:
                sums[lang] = n
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "f", "n"])


def _has_letter(data: np.ndarray) -> bool:
    folded = _FOLD[data]
    if ((folded >= 97) & (folded < 123)).any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "ignore"))


def mixture(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """EM for proportions, until they change by less than EM_CHANGE. p: languages x features likelihoods, n: counts; returns (proportions, log likelihood)."""
    pi = np.full(len(p), 1 / len(p))
    total = n.sum()
    mixed = pi @ p
    if len(p) > 1:
        for _ in range(rounds):
            was, pi = pi, pi * (p @ (n / mixed)) / total
            mixed = pi @ p
            if np.abs(pi - was).max() < EM_CHANGE:
                break
    return pi, float(n @ np.log(mixed))


def infer(p: np.ndarray, n: np.ndarray, penalty: float) -> tuple[int, float]:
    """(language number, its proportion) after choosing the set of languages, which grows as long as the penalised likelihood falls."""
    pi, _ = mixture(p, n, EM_ROUNDS)
    order = np.argsort(-pi, kind="stable")
    single = n @ np.log(p).T
    best = int(np.argmax(single))
    step = penalty * np.log(max(2.0, n.sum()))
    cost, chosen = -2 * single[best] + step, (best, 1.0)
    for size in range(2, len(p) + 1):
        part = order[:size]
        own, ll = mixture(p[part], n, EM_ROUNDS)
        if -2 * ll + step * size >= cost:
            break
        k = int(np.argmax(own))
        cost, chosen = -2 * ll + step * size, (int(part[k]), float(own[k]))
    return chosen


def _predict(model, penalty: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = model.value
        for b in batches:
            data, offsets = buffers(b.column("text"))
            names, scores = [], []
            for i in range(b.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                if not langs or not _has_letter(own):
                    names.append("und")
                    scores.append(0.0)
                    continue
                n = np.bincount(trigrams(own), minlength=FEATURES)
                at = np.flatnonzero(n)
                k, share = infer(p[:, at], n[at].astype(float), penalty)
                names.append(langs[k])
                scores.append(min(1.0, share))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def learn(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed trigram probabilities, from all rows of texts (lang, text)."""
    got = texts.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_count, "lang string, f long, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(got.column("lang").to_pylist(), dtype=object)
    langs = sorted(set(names))
    p = np.full((len(langs), FEATURES), 0.5)
    for k, lang in enumerate(langs):
        own = names == lang
        p[k, got.column("f").to_numpy()[own]] += got.column("n").to_numpy()[own]
    return langs, p / p.sum(axis=1, keepdims=True) if langs else p


def predict_languages(docs: DataFrame, held_out, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from text and lang of rows that aren't held_out."""
    d = docs.select("doc_id", held_out.alias("held_out"), "lang", "text")
    model = docs.sparkSession.sparkContext.broadcast(learn(d.filter(~F.col("held_out"))))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.select("doc_id", "held_out", "text").mapInArrow(_predict(model, penalty), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document; crc32(doc_id) mod 3 = 1 is held out."""
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)), F.lit(0))
    return predict_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold == 1)
