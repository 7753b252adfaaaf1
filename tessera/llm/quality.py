"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are estimated, one from
all trusted documents and one from the whole raw corpus.  A document's score is
the mean over its n-grams of ``log p_trusted - log p_raw``; it is kept when the
score reaches a threshold that all labelled documents fix before any document
is judged.  Everything is DataFrame expressions; the only thing on the driver
is the table of ``BUCKETS`` weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.common import let, scratch, staged, words
from tessera.operators.positions import numbered

#: Hash buckets of the multinomials, smoothing, and blocks of labels that are joined by broadcast (more are shuffled).
BUCKETS, ALPHA, BLOCKS = 10_000, 1.0, 1_000_000
#: Documents of fewer words or of more repetition (percent) fail the base rules.
MIN_WORDS, MAX_REPEATED = 50, 50


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _ngrams(h: Column) -> Column:
    """Buckets of the unigrams and of the bigrams, in text order."""
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    pairs = F.transform(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda x, i: bucket(F.xxhash64(F.get(h, i), x)))
    return F.concat(F.transform(h, bucket), pairs)


def _repeated(h: Column, spare: int = 0) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Most texts have no such window, which a set of their hashes tells.  In the
    others, window hashes give way in their low bits to the window's position
    and are sorted as plain numbers: equal windows become neighbours, at no
    cost quadratic in the text.  Where the bits that are left don't tell all
    windows apart (texts of millions of words), hash and position are sorted
    as pairs, which is slower.  ``spare`` bits more give way (for tests).
    """
    shr = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    shl = lambda x, n: F.call_function("shiftleft", x, n)

    def covered(starts: Column) -> Column:
        gap = F.transform(starts, lambda x, j: F.least(F.lit(3).cast("long"), F.coalesce(x - F.get(starts, j - 1), F.lit(3).cast("long"))))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(s: Column, same, place) -> Column:
        """Positions of the windows that a neighbour equals, in order."""
        both = lambda a, b: F.when(same(a, b), F.array(place(a), place(b)))
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), both)))))

    def counted(x: Column) -> Column:
        windows, bits = x["windows"], x["bits"]
        mask = shl(F.lit(1).cast("long"), bits) - 1
        numbers = F.transform(windows, lambda x, i: shl(shr(x, bits), bits) + i.cast("long"))
        pairs = F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))
        by_number = let(F.sort_array(numbers), lambda s: twice(s, lambda a, b: shr(a.bitwiseXOR(b), bits) == 0, lambda a: a.bitwiseAND(mask)))
        by_pair = let(F.sort_array(pairs), lambda s: twice(s, lambda a, b: a["x"] == b["x"], lambda a: a["i"]))
        told = F.size(F.array_distinct(F.transform(windows, lambda x: shr(x, bits)))) == x["distinct"]
        return F.when(x["distinct"] == F.size(windows), F.lit(0).cast("long")).when(told, let(by_number, covered)).otherwise(let(by_pair, covered))

    windows = F.transform(F.slice(h, 3, F.greatest(F.size(h), F.lit(1))), lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), x))
    marked = let(windows, lambda w: F.struct(w.alias("windows"), F.size(F.array_distinct(w)).alias("distinct"), (F.length(F.bin(F.size(w).cast("long"))) + spare).alias("bits")))
    return F.when(F.size(h) < 3, F.lit(0).cast("long")).otherwise(let(marked, counted))


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.when(F.contains(text, F.lit("\n")), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(F.lit(0))


def _measures(text: Column, weights: Column | None) -> Column:
    """All counts of a text, and its score where weights are given."""

    def measured(w: Column) -> Column:
        return let(
            _hashes(w),
            lambda h: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeated(h).alias("n_repeat_words"),
                (_mean(_ngrams(h), weights) if weights is not None else F.lit(None).cast("double")).alias("score"),
            ),
        )

    return let(words(text), measured)


def _failed(m: Column) -> Column:
    """The base rules on measures."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])


def _mean(buckets: Column, weights: Column) -> Column:
    return let(buckets, lambda b: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(weights, x)) / F.size(b)))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted) of every labelled document.

    Trusted is quality 1; an id with several labels is trusted if all say so.
    """
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("trusted"))


#: The name of old; nothing is sampled.
trusted_sample = trusted_labels


def _place(packed: bool) -> tuple[Column, Column]:
    """Block and bit of an id: 64 neighbouring whole numbers share a block, any other id has its own."""
    if not packed:
        return F.col("doc_id").alias("block"), F.lit(1).cast("long").alias("bit")
    i = F.col("doc_id").cast("long")
    return F.shiftright(i, 6).alias("block"), F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("bit")


def _percentiles(scores: DataFrame, shares: list[float]) -> dict[bool, list[float]]:
    """Exact percentiles of the scores of each value of ``trusted``, by linear
    interpolation as in F.percentile.  They are looked up by position in a
    range sort, so no task and no driver holds all scores."""
    n = {r["trusted"]: r["count"] for r in scores.groupBy("trusted").count().collect()}
    first = {False: 0, True: n.get(False, 0)}
    at = {k: [s * (n[k] - 1) for s in shares] for k in n}
    wanted = sorted({first[k] + f(x) for k in n for x in at[k] for f in (math.floor, math.ceil)})
    if not wanted:
        return {}
    order = [F.col("trusted"), F.col("score"), F.col("tie")]  # a tie's rows are dealt over tasks
    placed = numbered(scores.withColumn("tie", F.monotonically_increasing_id()), order, "at").where(F.col("at").isin(wanted))
    score = {r["at"]: r["score"] for r in placed.collect()}

    def between(k: bool, x: float) -> float:
        i, j = math.floor(x), math.ceil(x)
        low, high = score[first[k] + i], score[first[k] + j]
        return low if low == high else (j - x) * low + (x - i) * high

    return {k: [between(k, x) for x in at[k]] for k in n}


def llr_model(docs: DataFrame, labelled: DataFrame) -> tuple[list[float], float]:
    """Weights of the buckets, and the threshold, from all documents and all
    labelled ones (``labelled``: doc_id and trusted, a row for each id).

    The threshold is set on labelled documents that pass the base rules (on all
    where none does).  It lies a quarter of the way up from the rejected documents'
    highest scores (their 95th percentile) to the trusted ones' lowest (their
    0.5th), as a doubtful document should stay, or at the latter where the two
    overlap; without rejected documents it is the
    trusted ones' minimum.  Without trusted documents all weights are 0 and
    every document reaches the threshold.

    Labels travel to the texts as blocks of bits, by broadcast unless there are
    more than ``BLOCKS`` of them.
    """
    with scratch(docs.sparkSession):
        return _model(docs, labelled)


def _model(docs: DataFrame, labelled: DataFrame) -> tuple[list[float], float]:
    packed = all(isinstance(df.schema["doc_id"].dataType, IntegralType) for df in (docs, labelled))
    marks = labelled.select(*_place(packed), "trusted").groupBy("block").agg(F.bit_or("bit").alias("known"), F.bit_or(F.when(F.col("trusted"), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias("good"))
    marks = staged(marks, "marks")
    few = marks.count() <= BLOCKS
    near = F.broadcast(marks) if few else marks
    texts = docs.select(*_place(packed), "text")
    has = lambda bits: F.col(bits).bitwiseAND(F.col("bit")) != 0

    grams = texts.join(near, "block", "left").select(F.coalesce(has("good"), F.lit(False)).alias("t"), F.explode(let(words(F.col("text")), lambda w: let(_hashes(w), _ngrams))).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("r"), F.count_if("t").alias("t")).collect()  # BUCKETS rows
    raw, good = sum(r["r"] for r in rows), sum(r["t"] for r in rows)
    weights = [0.0] * BUCKETS
    if not good:
        return weights, 0.0
    seen = {r["b"]: (r["r"], r["t"]) for r in rows}
    for b in range(BUCKETS):
        r, t = seen.get(b, (0, 0))
        weights[b] = round(math.log((t + ALPHA) / (good + ALPHA * BUCKETS)) - math.log((r + ALPHA) / (raw + ALPHA * BUCKETS)), 6)
    # base rules decide without a score; a filter would be moved below the join and measure every document
    m = _measures(F.col("text"), _constant(weights)).alias("m")
    if few:
        scored = texts.join(near, "block").where(has("known")).select(has("good").alias("trusted"), m)
    else:  # measures move instead of texts
        scored = texts.select("block", "bit", m).join(near, "block").where(has("known")).select(has("good").alias("trusted"), "m")
    scored = staged(scored.select("trusted", F.col("m.score").alias("score"), _failed(F.col("m")).alias("failed")), "scores").where("score is not null")
    passed = [r["trusted"] for r in scored.where("not failed").select("trusted").distinct().collect()]
    p = _percentiles(scored.where(~F.col("failed") | ~F.col("trusted").isin(passed)), [0.0, 0.005, 0.95])
    if True not in p:
        return weights, -math.inf
    if False not in p:
        return weights, p[True][0]
    low, high = p[True][1], p[False][2]
    return weights, min(high + (low - high) / 4, low)


def _constant(weights: list[float]) -> Column:
    """The weights as one array constant, folded when the query is optimized."""
    return F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdicts of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score.  Null text counts as no words
    and fails; a text without n-grams has a null score and fails with it.
    Repeated rows and ids are judged row by row; empty tables give no rows;
    other columns are not read.
    """
    weights, threshold = llr_model(docs, trusted_labels(labels))
    return _judged(docs.select("doc_id", "text"), weights, threshold).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False))).alias("kept"), "score"
    )


def _judged(docs: DataFrame, weights: list[float], threshold: float) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    m = docs.withColumn("__m", _measures(F.col("text"), _constant(weights)))
    return m.select(
        *docs.columns,
        "__m.n_words",
        "__m.word_chars",
        _removed(text, r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        _duplicate_lines(text).cast("long").alias("n_dup_lines"),
        "__m.n_repeat_words",
        _failed(F.col("__m")).alias("base_failed"),
        "__m.score",
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose verdict is kept, with their own columns."""
    weights, threshold = llr_model(docs, trusted_labels(labels))
    m = F.col("__m")
    return docs.withColumn("__m", _measures(F.col("text"), _constant(weights))).where(~_failed(m) & (m["score"] >= threshold)).drop("__m")
