"""N-gram Jaccard self-join through count vectors, and its connected components.

A document's set is its distinct lower-cased five-word shingles.  Two documents
link when ``|A & B| / |A | B| >= 0.8``; the answer is the component of each.

How the join finds its pairs
----------------------------
1. *Blocks.*  Documents are brought together before they are indexed.  Shingle
   hashes are dealt into groups.  For two linked sets of sizes a and b,
   ``|A ^ B| <= (a + b) / 9``, so with about b / 3 groups a good part of the
   groups holds the same shingles on both sides.  The contents of each of the
   first ``KEYS`` groups name a block, so linked sets meet in many blocks (a
   miss needs every one of them to be broken: below 1e-9 for the worst pair at
   exactly 0.8, far below for closer ones).  Sets under 64 shingles are in the
   blocks of their rarest shingles, as many as a linked set can't all miss.  A
   block needs several shingles in common and no others there, so a passage
   that many documents share makes no hot block of all of its holders.  Blocks
   of the same members are one.
2. *Count-vector R-tree.*  Each block is an R-tree packed over its members'
   vectors of group counts (blocks of over ``TREE`` members are several trees).
   A pair's overlap is at most the sum of coordinate minima, a box's at most
   the minima with its upper corner, so a search gives every member that could
   reach the threshold.  All pairs come from such searches, in two rounds: in
   the first, each block's trees are searched for one member, the one that
   meets others in the most blocks (of a text and its edited copies, the
   text); in the second, in blocks that are not yet one component, for all
   members outside of the block's largest component.  So a group of copies
   gives a pair or two for each member, not all pairs, and no pair is skipped
   unless it is known to be one component.
3. *Verification.*  Pairs are intersected exactly.

Sets are named by 64-bit hashes of their content; exact copies share the name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_hot, staged
from tessera.llm.shingles import U, mix, pieces, shingle_sets, sums

#: Similarity as a fraction: 100 * shared >= 80 * united.
NUM, DEN = 80, 100
#: Keys of a set at most; points of an R-tree and of a leaf.
KEYS, TREE, LEAF = 64, 2048, 16
#: Mean shingles in a group at the upper end of a size class.
LOAD = 3.9
#: Common shingles told to the executors, and how often a piece has one at least.
COMMON, OFTEN = 1 << 16, 8
#: 64-bit words of the filter that spares unpaired sets the second pass.
FILTER_WORDS = 1 << 17


def enough(shared, a, b):
    """Whether sets of sizes a and b that share so many shingles link."""
    return DEN * shared >= NUM * (a + b - shared)


def set_names(s: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A name of each set: a hash of its content and size."""
    return mix(sums(mix(s ^ U(0x5BD1E995)), offs) + mix(np.diff(offs).astype(U))).astype(np.int64)


def group_keys(s: np.ndarray, offs: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every set under its own size class and, where a set could
    link to one of the class below, under that class as well.

    Small sets have their first shingles as keys, ``n - ceil(0.8 n) + 1`` of
    them, in an order of all shingles that puts the ``common`` ones (sorted)
    last; two linked sets share one of those, whatever the order.
    """
    n = np.diff(offs)
    level = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    first = _firsts(s, offs, row, common)
    keys, rows = [], []
    for shift in (0, 1):
        c = level - shift
        use = (n > 0) & (c >= 0) & ((shift == 0) | (n * NUM <= DEN * (1 << np.maximum(level, 0))))
        groups = np.where(c < 6, 1 << 32, np.ceil(1.25 * 2.0 ** (c + 1) / LOAD)).astype(np.int64)
        # group of each shingle; sets are sorted, so a group's shingles are neighbours
        group = ((s >> U(32)) * groups.astype(U)[row]) >> U(32)
        take = use[row] & np.where(c[row] < 6, first, group < U(KEYS))
        g, r, h = group[take], row[take], s[take]
        if not len(g):
            continue
        start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]))
        content = sums(mix(h), np.concatenate([start, [len(h)]]))
        with np.errstate(over="ignore"):
            keys.append(mix(content ^ mix(g[start] + c[r[start]].astype(U) * U(0x100000001B3))).astype(np.int64))
        rows.append(r[start])
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def _firsts(s: np.ndarray, offs: np.ndarray, row: np.ndarray, common: np.ndarray | None) -> np.ndarray:
    """Which shingles are among the first of their set, common ones last."""
    n, place = np.diff(offs), np.arange(len(s)) - np.repeat(offs[:-1], np.diff(offs))
    if common is not None and len(common):
        late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
        if late.any():
            order = np.lexsort((place, late, row))
            place[order] = np.arange(len(s)) - offs[row[order]]
    return place < (n - -(-NUM * n // DEN) + 1)[row]


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, n) of what small sets of a piece have in common."""
    for batch in batches:
        for _, data, offs in pieces(batch.column(0)):
            s, at = shingle_sets(data, offs)
            value, n = np.unique(s[np.repeat(np.diff(at) < 128, np.diff(at))], return_counts=True)
            value, n = value[n >= OFTEN], n[n >= OFTEN]
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])


def common_shingles(texts: DataFrame) -> np.ndarray:
    """The COMMON commonest shingles of small sets, counted over all texts; an
    aid to the order of shingles only, which any list leaves exact."""
    rows = texts.mapInArrow(_frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(COMMON).select("shingle").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(U))


def dims(n: int) -> int:
    """Coordinates for sets of ``n`` shingles: a power of two near n, 32 to 4096."""
    return 1 << min(12, max(5, int(n).bit_length() - 1))


def counts(s: np.ndarray, offs: np.ndarray, d: int) -> np.ndarray:
    """The vector of ``d`` group counts of each set."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    cell = row * d + (mix(s) >> U(65 - d.bit_length())).astype(np.int64)
    return np.bincount(cell, minlength=(len(offs) - 1) * d).reshape(-1, d).astype(np.int32)


def _stars(common: np.ndarray):
    """Rows (key, node, pivot): each key's first member in the piece stands for
    it (no pivot); other members are paired with it here and travel by their
    own name, so that a key of many members is not dealt to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in pieces(batch.column(0)):
                s, at = shingle_sets(data, offs)
                key, row = group_keys(s, at, common)
                node = set_names(s, at)[row]
                order = np.lexsort((node, key))
                key, node = key[order], node[order]
                if not len(key):
                    continue
                new = np.concatenate([[True], key[1:] != key[:-1]])
                other = np.concatenate([[True], node[1:] != node[:-1]]) | new
                pivot = node[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
                key, node, pivot, new = key[other], node[other], pivot[other], new[other]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(pivot, mask=new)], ["key", "node", "pivot"])

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, (key, pivot, node) of different sets out: local pivots
    are paired with their key's least one.  One row is carried over."""
    last_key, last_pivot = None, None
    for batch in batches:
        key, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        stands = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        pivot = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
        new = np.concatenate([[last_key is None or key[0] != last_key or not stands[0]], (key[1:] != key[:-1]) | ~stands[1:] | ~stands[:-1]])
        first = np.where(new, np.arange(len(new)), -1)
        first = np.maximum.accumulate(first)
        least = np.where(first < 0, last_pivot if last_pivot is not None else 0, node[np.maximum(first, 0)])
        to = np.where(stands, least, pivot)
        out = to != node
        if stands[-1]:
            last_key, last_pivot = key[-1], least[-1]
        else:
            last_key = None
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(to[out]), pa.array(node[out])], ["key", "pivot", "node"])


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = col.value_lengths().to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False).view(U), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact verification of two sorted sets."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs merge in linear time
    return bool(enough(int((both[1:] == both[:-1]).sum()), len(x), len(y)))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets in, links out: minima of counts first, then the intersection."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        (fa, oa), (fb, ob) = _flat(batch.column(2)), _flat(batch.column(3))
        ok = np.zeros(len(a), bool)
        for i in range(len(a)):
            x, y = fa[oa[i] : oa[i + 1]], fb[ob[i] : ob[i + 1]]
            if enough(min(len(x), len(y)), len(x), len(y)):
                d = dims(len(x))
                u, v = (counts(z, np.array([0, len(z)]), d)[0] for z in (x, y))
                ok[i] = enough(int(np.minimum(u, v).sum()), len(x), len(y)) and _linked(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ok)], ["a", "b", "ok"])


class CountTree:
    """An R-tree packed over count vectors (sort-tile order on a few coordinates).

    ``search`` yields the points whose overlap with the query may reach the
    threshold.  Boxes keep the upper corner and the range of sizes.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((*points[:, :3].T, sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        high, lo, hi = self.points, self.sizes, self.sizes
        while len(high) > LEAF:
            cut = np.arange(0, len(high), LEAF)
            high, lo, hi = np.maximum.reduceat(high, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            self.levels.append((high, lo, hi))

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        at = None
        for high, lo, hi in reversed(self.levels):
            at = np.arange(len(high)) if at is None else at[at < len(high)]
            # a box can hold a partner if some size of its range fits and the minima suffice for the least such size
            least = np.maximum(lo[at], -(-NUM * size // DEN))
            fits = (least <= hi[at]) & (least * NUM <= size * DEN)
            at = at[fits & enough(np.minimum(high[at], point).sum(1), least, size)]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = np.arange(len(self.points)) if at is None else at[at < len(self.points)]
        return self.order[at[enough(np.minimum(self.points[at], point).sum(1), self.sizes[at], size)]]


def folded(vector: np.ndarray, d: int) -> np.ndarray:
    """A count vector in fewer coordinates: neighbouring groups are joined."""
    return vector.reshape(d, -1).sum(1) if len(vector) > d else vector


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of blocks (key, i, q), which arrive in order.

    Rows are key, i, q, node, label, n, vector (a byte for each coordinate),
    keys, indexed, query.  Each block's queries are searched in an R-tree over
    its members; pairs of one component are left out, and a pair that meets in
    several blocks is given by the one of its least common key, if keys are
    told.
    """
    held: list[tuple] = []
    pairs: set[tuple[int, int]] = set()

    def search() -> None:
        node, label, n = (np.array([r[k] for r in held]) for k in (3, 4, 5))
        raw = [np.frombuffer(r[6], np.uint8) for r in held]
        d = min(map(len, raw))
        points = np.stack([folded(v.astype(np.int32), d) for v in raw])
        # a byte that is full may stand for more; such a coordinate bounds nothing
        for i, v in enumerate(raw):
            if v.max(initial=0) == 255:
                points[i][folded((v == 255).astype(np.int32), d) > 0] = 1 << 20
        index = np.flatnonzero([r[8] for r in held])
        tree = CountTree(points[index], n[index])
        for i in np.flatnonzero([r[9] for r in held]).tolist():
            hit = index[tree.search(points[i], int(n[i]))]
            own = set(held[i][7])
            for j in hit[label[hit] != label[i]].tolist():
                if not own or next(k for k in held[j][7] if k in own) == held[i][0]:
                    pairs.add((min(node[i], node[j]), max(node[i], node[j])))

    def found() -> pa.RecordBatch:
        rows = sorted(pairs)
        pairs.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != r[:3]:
                search()
                held.clear()
            held.append(r)
        if len(pairs) > 100_000:
            yield found()
    if held:
        search()
    yield found()


def _filtered(words: dict[int, int]):
    """The second pass: (node, n, vector, shingles) of sets whose name is in the filter."""
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[list(words)] = list(words.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offs in pieces(batch.column(0)):
                s, at = shingle_sets(data, offs)
                node, n = set_names(s, at), np.diff(at)
                slot = mix(node.astype(U))
                hit = (bits[(slot >> U(6)).astype(np.int64) % FILTER_WORDS] >> (slot & U(63)).astype(np.int64)) & 1
                # copies in one piece are sent once
                rows = np.flatnonzero((hit == 1) & (n > 0))
                rows = rows[np.unique(node[rows], return_index=True)[1]]
                if not len(rows):
                    continue
                flat = np.concatenate([s[at[r] : at[r + 1]] for r in rows.tolist()]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(n[rows])]).astype(np.int32)
                vectors = [np.minimum(counts(x, np.array([0, len(x)]), dims(len(x)))[0], 255).astype(np.uint8).tobytes() for x in np.split(flat.view(U), ends[1:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[rows]), pa.array(n[rows].astype(np.int64)), pa.array(vectors, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "n", "vector", "shingles"]
                )

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, node) of every row; node is null for an empty set."""
    for batch in batches:
        for row, data, offs in pieces(batch.column(1)):
            s, at = shingle_sets(data, offs)
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(n)), pa.array(n.astype(np.int64)), pa.array(set_names(s, at), mask=n == 0)], ["doc_id", "n_shingles", "node"]
            )


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): label is the least node
    of its component.  Large and small stars alternate until nothing moves;
    each round is a few joins and aggregations, written to shared storage."""
    edges = staged(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    marks = (F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))"))
    then = edges.agg(*marks).first()
    while True:
        n = 2 * then[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")), "least")
        large = staged(join_hot(both, least, "u", n).where("v > u").select(F.col("m").alias("u"), "v").where("u <> v"), "large")
        small = staged(large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("c")), "small")
        after = join_hot(large, small, "v", n).select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v")).unionByName(small.select(F.col("m").alias("u"), "v"))
        after = staged(after.where("u <> v").distinct(), "edges")
        now = after.agg(*marks).first()
        if now == then:
            break
        then = now
        edges = after
    # stars now: every node has one edge to the least of its component
    return edges.select(F.col("v").alias("node"), F.col("u").alias("label")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())


def _sets_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, vector, shingles) of the given nodes, one row each.

    A filter of fixed size, made of their names, goes to the executors: a set
    that passes by chance costs some shuffle and is dropped by the join.
    """
    words = nodes.mapInArrow(_slots, "word int, bit int").distinct().groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect()  # at most FILTER_WORDS rows
    found = texts.mapInArrow(_filtered({r["word"]: r["bits"] for r in words}), "node long, n long, vector binary, shingles array<long>")
    return staged(found.join(nodes, "node", "left_semi").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "vector", "shingles"))), "sets")


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(U))
        yield pa.RecordBatch.from_arrays([pa.array(((slot >> U(6)).astype(np.int64) % FILTER_WORDS).astype(np.int32)), pa.array((slot & U(63)).astype(np.int32))], ["word", "bit"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok) of every pair, with both sets brought to it by joins."""
    s = sets.select("node", "shingles")
    return (
        pairs.join(s.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(s.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
        .select("a", "b", "sa", "sb")
        .mapInArrow(_verified, "a long, b long, ok boolean")
    )


def _searches(blocks: DataFrame, sets: DataFrame, keys: bool) -> DataFrame:
    """Candidate pairs (a, b) of blocks (key, node, label, query, tiles): every
    query is searched in the trees of its block, but for its own label.

    Tiles bound what a task holds; each tile of members is an R-tree and meets
    each tile of queries.  ``keys`` sends a node's keys along (2 * KEYS at most,
    or the first shingles of a small set), so that a pair comes from one block.
    """
    tiled = blocks.select("key", "node", "label", "query", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
    sides = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("tiles") - 1),
            lambda t: F.array(
                F.struct(F.col("tile").alias("i"), t.alias("q"), F.lit(True).alias("indexed"), (F.col("query") & (F.col("tile") == t)).alias("query")),
                F.struct(t.alias("i"), F.col("tile").alias("q"), F.lit(False).alias("indexed"), (F.col("query") & (F.col("tile") != t)).alias("query")),
            ),
        )
    )
    # a tile of members goes only where a tile has queries; vectors are joined last, so they are dealt once
    asked = tiled.where("query").select("key", F.col("tile").alias("q")).distinct()
    dealt = tiled.select("key", "node", "label", F.explode(sides).alias("s")).where("s.indexed or s.query")
    dealt = dealt.select("key", "s.i", "s.q", "node", "label", "s.indexed", "s.query").join(asked, ["key", "q"], "left_semi")
    if keys:
        dealt = dealt.join(blocks.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys")), "node")
    else:
        dealt = dealt.withColumn("keys", F.array().cast("array<long>"))
    dealt = dealt.join(sets.select("node", "n", "vector"), "node").select("key", "i", "q", "node", "label", "n", "vector", "keys", "indexed", "query")
    return dealt.repartition("key", "i", "q").sortWithinPartitions("key", "i", "q").mapInArrow(_searched, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Component of every document under links of Jaccard similarity >= 0.8.

    Returns doc_id, n_shingles, component_id, one row for each input row.
    Null or wordless texts have an empty set and are components of their own;
    so are rows with a null id (component null).  Rows that repeat an id keep
    their rows; an id with several texts joins their components only if the
    texts link.  A pair at exactly the threshold links.  A text of any length
    is read whole, in parts.  Empty tables give no rows; other columns are not
    read.
    """
    texts = docs.select("text")
    stars = texts.mapInArrow(_stars(common_shingles(texts)), "key long, node long, pivot long")
    dealt = stars.repartition(F.when(F.col("pivot").isNull(), F.col("key")).otherwise(F.col("node")))
    paired = dealt.sortWithinPartitions(F.col("pivot").isNotNull(), "key", "node").mapInArrow(_chain, "key long, pivot long, node long")
    members = staged(paired.select("key", F.explode(F.array("pivot", "node")).alias("node")).distinct(), "members")
    # the same members under several keys are one block
    block = staged(
        members.groupBy("key")
        .agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 7))").alias("y"))
        .groupBy("m", "x", "y")
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("m") / TREE).cast("int").alias("tiles"), F.col("m").alias("c")),
        "block",
    )
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    blocks = staged(join_hot(members, block, "key", members.count()).join(degree, "node"), "blocks")
    n = blocks.count()
    pivots = staged(blocks.groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("pivot"), F.count("*").alias("c")), "pivots")
    sets = _sets_of(texts, blocks.select("node").distinct())

    first = join_hot(blocks, pivots, "key", n).select("key", "node", F.col("node").alias("label"), (F.col("node") == F.col("pivot")).alias("query"), "tiles")
    pairs = staged(_searches(first, sets, keys=False), "pairs")
    links = staged(_links(pairs, sets).where("ok").select("a", "b"), "links")
    label = components(links)

    marked = staged(blocks.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "marked")
    parts = marked.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_keys = staged(parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("c")).where("parts > 1"), "keys")
    second = staged(join_hot(marked, open_keys, "key", n).select("key", "node", "label", (F.col("label") != F.col("main")).alias("query"), "tiles"), "open")
    candidates = _searches(second, sets, keys=True)
    found = staged(_links(candidates.join(pairs, ["a", "b"], "left_anti"), sets).where("ok").select("a", "b"), "links")
    if not found.isEmpty():
        label = components(links.unionByName(found))

    named = docs.select("doc_id", "text").mapInArrow(_named, docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ") + ", n_shingles long, node long")
    firsts = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = staged(firsts, "firsts")
    least = staged(firsts.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("c")), "least")
    of_node = join_hot(firsts.select("node", "label"), least, "label", firsts.count()).select("node", "component_id")
    return named.join(of_node, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each component one row stays,
    that of the least doc_id, a row without an id only where no other has one.

    Rows are told by id and text, so rows that share an id are judged each, and
    of rows that repeat both one stays.  Null and wordless texts are copies of
    nothing; those without an id all stay.  Columns are those of ``docs``."""
    from pyspark.sql import Window

    keyed = docs.withColumn("__key", F.xxhash64("text"))
    found = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text")).distinct()
    found = found.select(F.col("doc_id").alias("__key"), "component_id", (F.col("n_shingles") == 0).alias("blank"))
    # keys are aggregated before they are joined, so many copies of a text meet in no task
    first = keyed.groupBy("__key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
    best = first.join(found.where("not blank"), "__key").groupBy("component_id").agg(F.min(F.struct("first", "__key")).alias("best"))
    best = best.select(F.col("best.first.doc_id").alias("__id"), F.col("best.__key").alias("__of"))
    blank = found.where("blank").select(F.col("__key").alias("__of"))
    of_key = F.col("__key") == F.col("__of")
    kept = keyed.join(best, of_key & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    empty = keyed.join(blank, of_key, "left_semi")
    one = kept.unionByName(empty.where("doc_id is not null"))
    one = one.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy("__key"))).where("__n = 1")
    return one.select(docs.columns).unionByName(empty.where("doc_id is null").select(docs.columns))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
