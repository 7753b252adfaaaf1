"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document when at least ``threshold`` of the item's
five-word shingles are among the document's.  Items are short and documents
long, so the Jaccard similarity of the two says nothing.  Items are therefore
partitioned by size; for each partition documents are cut into windows of
twice the partition's largest item, half overlapping, and one-permutation
MinHash signatures of item and window are compared: hashes are dealt into bins
and each bin keeps its minimum.  An item is a candidate of a document when any
bin's minimum of any window is that of the item.

The number of bins follows from the partition: with a share of at least
``threshold`` of an item's shingles present, each is its bin's minimum with
probability at least 1 - load / 2, so the load that makes the chance of no
match at all less than ``MISS`` gives the bins.  Candidates are verified by the
exact containment of their shingles in the whole document.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shingles import U, mix, pieces, shingle_hashes, shingle_sets, word_hashes

#: Chance that a contained item has no matching bin.
MISS = 1e-9
#: Bytes of item texts sent to the executors at a time; more are searched in further blocks.
BLOCK = 32 << 20
THRESHOLD = 0.8


@dataclass
class Partition:
    """Items of one size class, with their signatures sorted by (bin, minimum)."""

    window: int
    bins: int
    entry: np.ndarray  # bin and minimum in one number, sorted
    item: np.ndarray  # the item of each entry
    minima: np.ndarray  # the distinct minima of all items

    def sieve(self) -> tuple[np.ndarray, np.uint64]:
        """A table by leading bits of which hashes may be a minimum of an item."""
        bits = min(26, max(16, int(len(self.minima)).bit_length() + 7))
        table = np.zeros(1 << bits, bool)
        table[(self.minima >> U(64 - bits)).astype(np.int64)] = True
        return table, U(64 - bits)


@dataclass
class Index:
    """Signatures and sets of one block of items."""

    partitions: list[Partition]
    ids: np.ndarray
    shingles: np.ndarray
    offs: np.ndarray


def _entries(h: np.ndarray, group: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, group, minimum) of each bin of each group; groups ascend."""
    at = (mix(h) >> U(32)) % U(bins)
    order = np.lexsort((h, at, group))
    g, b, x = group[order], at[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (g[1:] != g[:-1]) | (b[1:] != b[:-1])
    return mix(x[new] ^ b[new]), g[new], x[new]


def index_items(ids: np.ndarray, texts: pa.Array, threshold: float = THRESHOLD) -> Index:
    parts = [(row, *shingle_sets(data, offs)) for row, data, offs in pieces(texts)]
    s = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, U)
    n = np.concatenate([np.diff(p[2]) for p in parts]) if parts else np.empty(0, np.int64)
    offs = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    item = np.repeat(np.arange(len(n)), n)
    out = []
    for level in np.unique(np.floor(np.log2(n[n > 0])).astype(int)).tolist():
        low, high = 1 << level, 2 << level
        load = 2 * MISS ** (1 / math.ceil(threshold * low))
        window = 2 * high
        bins = min((1 << 31) - 1, math.ceil(window / load))
        own = (n[item] >= low) & (n[item] < high)
        entry, of, least = _entries(s[own], item[own], bins)
        order = np.argsort(entry, kind="stable")
        out.append(Partition(window, bins, entry[order], of[order], np.unique(least)))
    return Index(out, ids, s, offs)


def _found(h: np.ndarray, offs: np.ndarray, p: Partition, table: np.ndarray, shift_bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) of windows that share a bin's minimum with an item.

    The two half-overlapping families of windows are two rounds of disjoint
    ones.  A bin's minimum can only match where it is a minimum of some item,
    so signatures are made of the windows that hold such a hash.
    """
    near = np.flatnonzero(table[(h >> shift_bits).astype(np.int64)])
    none = np.empty(0, np.int64)
    hits = []
    if len(near):
        doc = np.searchsorted(offs, near, "right") - 1
        place = near - offs[doc]
        for shift in (0, p.window // 2):
            # windows that hold such a hash, as (document, number)
            number = (place + shift) // p.window
            new = np.ones(len(near), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
            d, w = doc[new], number[new]
            start = offs[d] + np.maximum(w * p.window - shift, 0)
            size = np.minimum(offs[d] + (w + 1) * p.window - shift, offs[d + 1]) - start
            group = np.repeat(np.arange(len(d)), size)
            at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            entry, of, _ = _entries(h[at], group, p.bins)
            lo = np.searchsorted(p.entry, entry, "left")
            many = np.searchsorted(p.entry, entry, "right") - lo
            hit = np.flatnonzero(many)
            if len(hit):
                m = many[hit]
                to = np.repeat(lo[hit], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                hits.append(np.stack([np.repeat(d[of[hit]], m), p.item[to]], 1))
    if not hits:
        return none, none
    both = np.unique(np.concatenate(hits), axis=0)
    return both[:, 0], both[:, 1]


def _hits(index: Index, sieves: list[tuple], data: np.ndarray, offs: np.ndarray, threshold: float) -> tuple[list[int], list[int], list[int]]:
    """(text, item, shingles shared) of the items that are found in a run of texts."""
    h, at = shingle_hashes(*word_hashes(data, offs))
    docs, items, shared = [], [], []
    pairs = [_found(h, at, *p) for p in sieves]
    d, i = (np.concatenate([x[k] for x in pairs]) if pairs else np.empty(0, np.int64) for k in (0, 1))
    order = np.argsort(d, kind="stable")
    last, own = -1, None
    for x, y in zip(d[order].tolist(), i[order].tolist(), strict=True):
        if x != last:
            last, own = x, np.unique(h[at[x] : at[x + 1]])
        q = index.shingles[index.offs[y] : index.offs[y + 1]]
        where = np.minimum(np.searchsorted(own, q), len(own) - 1)
        both = int((own[where] == q).sum())
        if both >= threshold * len(q):
            docs.append(x), items.append(y), shared.append(both)
    return docs, items, shared


def _search(index: Index, threshold: float):
    """(doc_id, item_id, n_item, n_shared) of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = [(p, *p.sieve()) for p in index.partitions]
        for batch in batches:
            for row, data, offs in pieces(batch.column(1)):
                docs, items, shared = _hits(index, sieves, data, offs, threshold)
                of = np.array(items, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([row + x for x in docs], pa.int64())),
                        pa.array(index.ids[of], pa.int64()),
                        pa.array(np.diff(index.offs)[of].astype(np.int64)),
                        pa.array(shared, pa.int64()),
                    ],
                    ["doc_id", "item_id", "n_item", "n_shared"],
                )

    return run


def _without(index: Index, threshold: float, text: int):
    """The rows in whose text (column number ``text``) no item is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieves = [(p, *p.sieve()) for p in index.partitions]
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for row, data, offs in pieces(batch.column(text)):
                clean[[row + x for x in _hits(index, sieves, data, offs, threshold)[0]]] = False
            yield batch.filter(pa.array(clean))

    return run


def _blocks(items: DataFrame, block: int, threshold: float) -> Iterator[Index]:
    """The index of each block of items (item_id, text), of about ``block`` bytes of text."""
    n = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    for k in range(n):
        part: pd.DataFrame = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toPandas()
        yield index_items(part["item_id"].to_numpy(np.int64), pa.array(part["text"].tolist(), pa.string()), threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item in every document.

    One pass over the documents for each ``block`` bytes of benchmark text,
    which is what is sent to the executors; nothing is shuffled.  An item
    without id, words or text matches nothing, one of one to four words is the
    shingle of its whole sequence.  Documents with null text match nothing; a
    long one is searched whole.  Repeated rows of documents repeat their
    results; of items that repeat an id, each is searched and listed for
    itself.  An item at exactly the threshold is found.  Empty tables give no
    rows, other columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    found = None
    for index in _blocks(items, block, threshold):
        one = docs.select("doc_id", "text").mapInArrow(_search(index, threshold), f"doc_id {kind}, item_id long, n_item long, n_shared long")
        found = one if found is None else found.unionByName(one)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The documents in which no item was found, with their own columns.

    Each row is judged by its own text, whatever its id, where it is: nothing
    is shuffled.  Items without an id are searched, too; null texts match
    nothing; repeated rows stay or go together.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text")).alias("item_id"), "text")
    for index in _blocks(items, block, threshold):
        docs = docs.mapInArrow(_without(index, threshold, docs.columns.index("text")), docs.schema)
    return docs


cloudpickle.register_pickle_by_value(sys.modules[__name__])
