"""Language identification by multilingual mixture inference.

Learning counts hashed byte trigrams of every labelled training document, per
language.  A document is taken as a mixture: each of its trigrams comes from
one of its languages, and expectation-maximisation estimates the languages'
proportions.  How many languages it has is chosen by penalised likelihood over
the nested sets of its most probable ones; the prediction is the language of
the largest proportion in the chosen set, the score that proportion.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shingles import PIECE, pieces

#: Trigram buckets, additive smoothing, EM rounds, least change of a proportion.
BUCKETS, ALPHA, ROUNDS, STILL = 1 << 14, 0.5, 20, 1e-3
#: Cost of a further language in units of half a log of the trigram count; overlapping trigrams aren't independent.
PENALTY = 6.0
UND = "und"


@dataclass
class Model:
    langs: list[str]
    prob: np.ndarray  # BUCKETS x languages


def has_letter(raw: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a letter; numerals are none."""
    low = raw | 32
    return bool(((low >= 97) & (low <= 122)).any()) or any(c.isalpha() for c in raw[raw >= 128].tobytes().decode("utf-8", "replace"))


def _fold() -> np.ndarray:
    """Bytes with A-Z lowered and everything in ASCII that is no letter a space."""
    t = np.arange(256, dtype=np.uint32)
    t[65:91] += 32
    plain = np.arange(256)
    t[(plain < 128) & ~((t >= 97) & (t <= 122))] = 32
    return t


def _codes(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that ends at each byte but the first two, and whether it counts."""
    a, b, c = low[:-2], low[1:-1], low[2:]
    code = (a << np.uint32(16)) | (b << np.uint32(8)) | c
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 14), (b != 32) | ((a != 32) & (c != 32))


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram that holds a letter, and offsets by text.

    A text is read as if a space stood before it; runs of spaces make no
    trigrams but their edges.
    """
    fold, n = _fold(), len(data)
    low = np.full(n + 2 * len(offs), 32, np.uint32)
    # every text stands behind two spaces of its own
    at = np.arange(n) + np.repeat(2 * np.arange(1, len(offs)), np.diff(offs))
    low[at] = fold[data]
    code, keep = _codes(low)
    keep = keep[at - 2]
    ends = np.concatenate([[0], np.cumsum(keep)])
    return code[at - 2][keep].astype(np.int64), ends[offs]


def text_counts(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Trigram counts by bucket of each text; a long text is counted in parts."""
    if len(offs) == 2 and len(data) > 2 * PIECE:
        fold, total = _fold(), np.zeros(BUCKETS, np.int64)
        for i in range(0, len(data), PIECE):
            head = fold[data[i - 2 : i]] if i else np.full(2, 32, np.uint32)
            code, keep = _codes(np.concatenate([head, fold[data[i : i + PIECE]]]))
            total += np.bincount(code[keep].astype(np.int64), minlength=BUCKETS)
        yield total
        return
    t, at = trigrams(data, offs)
    for i in range(len(offs) - 1):
        yield np.bincount(t[at[i] : at[i + 1]], minlength=BUCKETS)


#: Languages counted at a time in a task.
OPEN = 256


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a partition: summed here, so little is shuffled."""
    total: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])], ["lang", "bucket", "n"])
        total.clear()

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for row, data, offs in pieces(batch.column(0)):
            here = langs[row : row + len(offs) - 1]
            if len(offs) == 2:
                total.setdefault(here[0], np.zeros(BUCKETS, np.int64))
                total[here[0]] += next(text_counts(data, offs))
                continue
            t, at = trigrams(data, offs)
            own = np.repeat(here, np.diff(at))
            for lang in set(here):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(t[own == lang], minlength=BUCKETS)
            if len(total) > OPEN:
                yield from out()
    yield from out()


def bucket_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): one row for each bucket of a language, at any partitioning."""
    rows = docs.select("text", F.col("lang").cast("string")).where("lang is not null and text is not null")
    return rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> Model:
    """Trigram probabilities of each language of (text, lang); languages times
    BUCKETS numbers at most come to the driver, whatever the size of the corpus."""
    rows = bucket_counts(docs).toPandas()
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((BUCKETS, len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[rows["bucket"].to_numpy(np.int64), rows["lang"].map(place).to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return Model(langs, (counts + ALPHA) / (counts.sum(0) + ALPHA * BUCKETS) if langs else counts)


def mixture(counts: np.ndarray, prob: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood by expectation-maximisation."""
    share, total = start, counts.sum()
    for _ in range(rounds):
        dense = prob @ share
        after = share * (prob.T @ (counts / dense)) / total
        still = np.abs(after - share).max() < STILL
        share = after
        if still:
            break
    return share, float(counts @ np.log(prob @ share))


def infer(counts: np.ndarray, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, proportions) of a text, chosen by penalised likelihood."""
    k = prob.shape[1]
    share, _ = mixture(counts, prob, np.full(k, 1 / k))
    order = np.argsort(-share, kind="stable")
    cost = PENALTY * 0.5 * np.log(max(2.0, counts.sum()))
    best, value = None, -np.inf
    for size in range(1, k + 1):
        own = order[:size]
        part, fit = mixture(counts, prob[:, own], share[own] / share[own].sum() if share[own].sum() > 0 else np.full(size, 1 / size), 5)
        if fit - size * cost <= value:
            break
        best, value = (own, part), fit - size * cost
    return best


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offs in pieces(batch.column(1)):
                lang, score, langs = [], [], []
                for i, n in enumerate(text_counts(data, offs)):
                    if not model.langs or not has_letter(data[offs[i] : offs[i + 1]]):
                        lang.append(UND), score.append(0.0), langs.append([])
                        continue
                    used = np.flatnonzero(n)
                    own, share = infer(n[used].astype(float), model.prob[used]) if len(used) else (np.array([0]), np.array([1 / len(model.langs)]))
                    top = int(np.argmax(share))
                    lang.append(model.langs[own[top]]), score.append(min(1.0, max(0.0, float(share[top]))))
                    langs.append([model.langs[x] for x in own])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(lang)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "languages"]
                )

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages) of every document.

    A text that is null or has no letter (numerals are none) is ``und`` with
    score 0; so is any text if nothing was learned.  Of equal proportions the
    language least by code point is predicted.  Rows are predicted one by one,
    repeated rows and ids alike; a text of any length is read whole, in parts;
    empty tables give no rows; only doc_id and text are read.
    """
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double, languages array<string>")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
