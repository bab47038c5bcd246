"""Scalar functions on names, relations, answers and questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: words that say nothing
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for",
    "from", "has", "have", "how", "i", "in", "is", "it", "its", "many",
    "of", "on", "or", "that", "the", "this", "to", "was", "were", "what",
    "when", "where", "which", "who", "whom", "whose", "why", "will",
    "with", "you", "your",
]
#: fixed value: a word, with inner hyphens and apostrophes
WORD = "[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
#: fixed values: how sentences begin that lead in to quoted answers
LEAD_INS = ["based on", "the answer", "therefore", "from the", "the evidence", "there is no", "note:"]


def relation_phrase(rel: Column) -> Column:
    """Readable form: last part after a dot, CamelCase split, _ and - as blanks."""
    last = F.element_at(F.split(rel, r"\."), -1)
    spaced = F.regexp_replace(last, "([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.translate(spaced, "_-", "  "), " +", " "))


def path_text(types: Column, rels: Column) -> Column:
    """`A -[r]-> B -[s]-> C`."""
    return F.concat(F.get(types, F.lit(0)), F.array_join(F.zip_with(rels, F.slice(types, 2, F.greatest(F.size(types) - 1, F.lit(0))), lambda r, t: F.concat(F.lit(" -["), r, F.lit("]-> "), t)), ""))


def relation_phrases(rels: DataFrame, curated: DataFrame) -> DataFrame:
    """rels: rel; curated: rel, noun, verb. rel, noun, verb: the curated forms, else the readable form for both."""
    auto = relation_phrase(F.col("rel"))
    d = rels.select("rel").distinct().join(curated, "rel", "left")
    return d.select("rel", F.coalesce("noun", auto).alias("noun"), F.coalesce("verb", auto).alias("verb"))


def content_tokens(text: Column) -> Column:
    """Distinct lower-case words of two letters or more that aren't stop words."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: (F.char_length(w) > 1) & ~w.isin(STOP_WORDS)))


def normalise_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[ _-]", "")


def percent_decoded(text: Column) -> Column:
    """%XX as the UTF-8 bytes they stand for; a plus sign, and a percent sign without two hex digits, stay."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B"))


def clean_name(name: Column) -> Column:
    """Without brackets at either end; of a URL (also in angle brackets) the last part, decoded; without angle brackets at either end."""
    bare = F.regexp_replace(name, r"^[\[\]]+|[\[\]]+$", "")
    tail = F.regexp_replace(F.regexp_extract(bare, r"^<?https?://[^ ]*/(.*)$", 1), ">+$", "")
    whole = F.when(bare.rlike(r"^<?https?://[^ ]*/"), percent_decoded(tail)).otherwise(bare)
    return F.regexp_replace(whole, "^[<>]+|[<>]+$", "")


def bracket_entity(question: Column, given: Column) -> Column:
    """First [x] of the question, else the given name."""
    got = F.regexp_extract(question, r"\[([^\]]+)\]", 1)
    return F.when(got == "", given).otherwise(got)


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def compare_text(a: Column, b: Column) -> Column:
    """-1, 0 or 1: as numbers, else as ISO dates, else as text."""
    na, nb = a.try_cast("double"), b.try_cast("double")
    da, db = a.try_cast("date"), b.try_cast("date")
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(na.isNotNull() & nb.isNotNull(), sign(na, nb)).when(da.isNotNull() & db.isNotNull(), sign(da, db)).otherwise(sign(a, b))


def answers_from_text(responses: DataFrame, anchors: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """responses: query_id, text. query_id, name.

    `{a, b}` groups if there are any (with anchors: but for yes and no); else, with known
    (query_id, name), the known names that the text holds; else lines, without bullets and
    numbering: the quoted names of lead-in sentences, the parts of lines of three or more,
    whole lines. anchors: query_id, anchor: never an answer.
    """
    bare = lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", "")
    # fixed values: the patterns of answer groups, bullets, numbering and lead-in quotes
    groups = F.regexp_extract_all("text", F.lit(r"\{([^}]+)\}"), F.lit(1))
    braced = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), bare)))
    if anchors is not None:
        braced = F.filter(braced, lambda x: ~F.lower(x).rlike("^(yes|no)"))
    line = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^[-*\u2022]\s*", ""), r"^[0-9]+[.)]\s*", "")
    leads = "^(" + "|".join(LEAD_INS) + ")"

    def names(x):
        inner = F.regexp_extract_all(x, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1))
        parts = F.split(bare(x), ", ")
        return F.when(F.lower(x).rlike(leads), inner).when(F.lower(x).contains("entities mentioned"), F.array().cast("array<string>")).when(F.size(parts) > 2, F.transform(parts, bare)).otherwise(F.array(bare(x)))

    lines = F.flatten(F.transform(F.transform(F.split("text", "\n"), line), names))
    d = responses.select("query_id", "text", F.size(groups).alias("n_groups"), braced.alias("braced"), lines.alias("lines"))
    out = lambda df, c: df.select("query_id", F.explode(c).alias("name")).filter("name <> ''")
    tiers = [out(d.filter("n_groups > 0"), "braced")]
    rest = d.filter("n_groups = 0")
    if known is not None:
        met = rest.join(known.hint("merge"), "query_id").filter(F.expr("contains(text, name)"))
        if anchors is not None:
            met = met.join(anchors.select("query_id", F.col("anchor").alias("name")).hint("merge"), ["query_id", "name"], "left_anti")
        met = met.select("query_id", "name").distinct()
        tiers += [met, out(rest.join(met.select("query_id").distinct().hint("merge"), "query_id", "left_anti"), "lines")]
    else:
        tiers.append(out(rest, "lines"))
    got = tiers[0]
    for t in tiers[1:]:
        got = got.unionByName(t)
    got = got.distinct()
    return got if anchors is None else got.join(anchors.select("query_id", F.col("anchor").alias("name")).hint("merge"), ["query_id", "name"], "left_anti")


def scores_from_text(responses: DataFrame, allowed: DataFrame) -> DataFrame:
    """responses: query_id, text; allowed: query_id, name. query_id, name, score from `{name (Score: x)}` of allowed names; without any, the allowed names that the text holds, with 0."""
    # fixed value: the pattern of a scored name
    rx = F.lit(r"\{([^(}]+?)\s*\(Score:\s*([0-9.]+)\)\}")
    z = F.arrays_zip(F.regexp_extract_all("text", rx, F.lit(1)).alias("name"), F.regexp_extract_all("text", rx, F.lit(2)).alias("score"))
    said = responses.select("query_id", F.explode(z).alias("z")).select("query_id", F.trim("z.name").alias("name"), F.expr("try_cast(z.score as double)").alias("score"))
    said = said.join(allowed.select("query_id", "name").distinct().hint("merge"), ["query_id", "name"], "left_semi")
    rest = responses.join(said.select("query_id").distinct().hint("merge"), "query_id", "left_anti")
    held = rest.join(allowed.hint("merge"), "query_id").filter(F.expr("contains(text, name)")).select("query_id", "name", F.lit(0.0).alias("score"))
    return said.unionByName(held.distinct())


def list_scores_from_text(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """responses: query_id, text; entities: query_id, names (array). query_id, name, score: a list of numbers is paired with the names if there are as many; else names that the text holds score 0.5, and if there are none all score 0."""
    found = F.regexp_extract("text", r"([0-9.]+(?:\s*,\s*[0-9.]+)+)", 1)
    numbers = F.transform(F.split(found, ","), lambda x: F.trim(x).try_cast("double"))
    d = responses.join(entities.hint("merge"), "query_id").select("query_id", "text", "names", numbers.alias("numbers"))
    fits = (F.size("numbers") == F.size("names")) & (F.size("names") > 1) & ~F.exists("numbers", lambda x: x.isNull())
    held = F.filter("names", lambda n: F.col("text").contains(n))
    score = F.when(fits, F.arrays_zip(F.col("names").alias("name"), F.col("numbers").alias("score"))).when(F.size(held) > 0, F.transform(held, lambda n: F.struct(n.alias("name"), F.lit(0.5).alias("score")))).otherwise(F.transform("names", lambda n: F.struct(n.alias("name"), F.lit(0.0).alias("score"))))
    return d.select("query_id", F.explode(score).alias("z")).select("query_id", "z.name", "z.score")


def relations_from_text(responses: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """responses: query_id, text; vocabulary: rel. query_id, rel: the first [a, b] list, else parts between commas and line ends without numbering, if they are in the vocabulary."""
    bare = lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", "")
    inner = F.regexp_extract("text", r"\[([^\]]+)\]", 1)
    parts = F.transform(F.split("text", "[,\n]"), lambda x: F.trim(F.regexp_replace(bare(x), r"^[0-9]+[.)]\s*", "")))
    d = responses.select("query_id", F.explode(F.when(inner != "", F.transform(F.split(inner, ","), bare)).otherwise(parts)).alias("rel"))
    return d.distinct().join(vocabulary.select("rel").distinct().hint("merge"), "rel", "left_semi").select("query_id", "rel")


def mentioned_entities(questions: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """questions: query_id, text; names: name. query_id, name, rank: names that share a content token with the question and occur in it, longest first."""
    q = questions.select("query_id", "text", F.explode(content_tokens(F.col("text"))).alias("token"))
    t = names.select("name").distinct().select("name", F.explode(content_tokens(F.col("name"))).alias("token"))
    met = q.join(t.hint("merge"), "token").filter(F.expr("contains(lower(text), lower(name))")).select("query_id", "name").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc(F.char_length("name")), "name")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def retrieve_hints(questions: DataFrame, entities: DataFrame, concepts: DataFrame, attributes: DataFrame, predicates: DataFrame, n: int = 10) -> DataFrame:
    """query_id, entities, concepts, attr_keys, predicates (arrays by rank): entities that are mentioned, concepts (n), keys and predicates (2n) by the share of their tokens."""
    kinds = {"entities": mentioned_entities(questions, entities, n).drop("share"), **{k: token_overlap_rank(questions, d, m).drop("share") for k, d, m in (("concepts", concepts, n), ("attr_keys", attributes, 2 * n), ("predicates", predicates, 2 * n))}}
    out = questions.select("query_id").distinct()
    for k, d in kinds.items():
        lists = d.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias(k))
        out = out.join(lists.hint("merge"), "query_id", "left").withColumn(k, F.coalesce(k, F.array().cast("array<string>")))
    return out


def token_overlap_rank(questions: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """Names by the share of their tokens that the question holds, through an equi-join on tokens. questions: query_id, text; names: name."""
    q = questions.select("query_id", F.explode(content_tokens(F.col("text"))).alias("token"))
    t = names.select("name", content_tokens(F.col("name")).alias("tokens")).distinct().select("name", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    s = q.join(t.hint("merge"), "token").groupBy("query_id", "name").agg((F.count("*") / F.first("size")).alias("share"))
    w = Window.partitionBy("query_id").orderBy(F.desc("share"), "name")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """pairs: id, gold, pred. F measure of n-gram overlap with counts, on lower-case tokens."""

    def grams(c: str) -> DataFrame:
        w = F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")
        g = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return pairs.select("id", F.explode(g).alias("g")).groupBy("id", "g").agg(F.count("*").alias(c))

    both = grams("gold").join(grams("pred").hint("merge"), ["id", "g"], "full")
    s = both.groupBy("id").agg(F.sum(F.least(F.coalesce("gold", F.lit(0)), F.coalesce("pred", F.lit(0)))).alias("hit"), F.sum("gold").alias("ng"), F.sum("pred").alias("np"))
    f = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("ng") + F.col("np"))).otherwise(F.lit(0.0))
    return pairs.select("id").join(s.select("id", f.alias("f")).hint("merge"), "id", "left").select("id", F.coalesce("f", F.lit(0.0)).alias("f"))


def _numbered(side: pa.ListArray, other: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Lengths and word numbers (equal words have one number) of two columns of word lists."""
    lens = [np.diff(x.offsets.to_numpy()) for x in (side, other)]
    words = pa.concat_arrays([side.flatten(), other.flatten()]).dictionary_encode().indices.to_numpy()
    return *lens, words[: len(side.flatten())], words[len(side.flatten()) :]


def lcs_lengths(g: pa.ListArray, p: pa.ListArray, cells: int = 1 << 21) -> np.ndarray:
    """Longest common subsequence of each pair of word lists. Pairs of like lengths go together: a row of all their tables is one array step."""
    n_g, n_p, w_g, w_p = _numbered(g, p)
    at_g, at_p = np.concatenate([[0], np.cumsum(n_g)]), np.concatenate([[0], np.cumsum(n_p)])
    out = np.zeros(len(n_g), dtype=np.int64)
    order = np.lexsort((n_g, n_p))
    i = 0
    while i < len(order):
        # lengths rise, so the last pair of a group is the widest
        j = i + max(1, int(np.searchsorted(np.arange(1, len(order) - i + 1) * (n_p[order[i:]] + 1), cells, side="right")))
        rows = order[i:j]
        wide, deep = int(n_p[rows].max()), int(n_g[rows].max())
        cols, steps = np.arange(wide), np.arange(deep)
        padded = lambda w, at, n, k, fill: np.where(k < n[rows][:, None], w[np.minimum(at[rows][:, None] + k, max(len(w) - 1, 0))] if len(w) else fill, fill)
        pred, gold = padded(w_p, at_p, n_p, cols, -1), padded(w_g, at_g, n_g, steps, -2)
        row = np.zeros((len(rows), wide + 1), dtype=np.int32)
        for t in range(deep):
            row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], row[:, :-1] + (pred == gold[:, t : t + 1])), axis=1)
        out[rows] = row[:, -1]
        i = j
    return out


def rouge_l(pairs: DataFrame) -> DataFrame:
    """id, r, p, f by longest common subsequence of case-folded tokens of whole texts, whole batches of pairs at a time inside the tasks."""

    def lengths(batches):
        for b in batches:
            g, p = b.column("g"), b.column("p")
            n = [pa.array(np.diff(x.offsets.to_numpy()).astype(np.int64)) for x in (g, p)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lcs_lengths(g, p)), *n], ["id", "lcs", "ng", "np"])

    words = lambda c: F.coalesce(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""), F.array().cast("array<string>"))
    kind = pairs.schema["id"].dataType.simpleString()
    d = pairs.select("id", words("gold").alias("g"), words("pred").alias("p")).mapInArrow(lengths, f"id {kind}, lcs long, ng long, np long")
    r, p = F.col("lcs") / F.greatest(F.col("ng"), F.lit(1)), F.col("lcs") / F.greatest(F.col("np"), F.lit(1))
    return d.select("id", r.alias("r"), p.alias("p"), F.when(F.col("lcs") > 0, 2 * r * p / (r + p)).otherwise(F.lit(0.0)).alias("f"))
