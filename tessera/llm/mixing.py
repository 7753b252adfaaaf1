"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold
them).  A small flow network routes token capacity from patterns to source
quotas; repeating a pattern costs more with every repetition, so fresh text is
used before copies.  The flow is solved over patterns on the driver (their
number is checked, documents never go there) and carried out by a seeded
selection: each pattern's documents are taken a whole number of times, and a
seeded part of them once more, cut where the pattern's share is reached.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import n_words, staged

#: Cost of a token's first, second and third use.
REPEAT_COSTS = (0, 1, 3)
#: Patterns and sources at most on the driver; more are refused, not dropped.
MAX_PATTERNS = 100_000
#: Hexadecimal digits of the seeded order that make a cell: the cut is found among
#: the 256 cells of two digits, then among those of four in one of them.
CELL_DIGITS = (2, 4)


def fill_targets(sizes: list[int], weights: list[int], most: float = len(REPEAT_COSTS)) -> list[float]:
    """Shares of the total by weight; a share over ``most`` times its size stops
    there and the excess is shared anew among the rest."""
    total, open_, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        whole = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > most * sizes[i] * whole}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= most * sizes[i]
        open_ -= over
    return out


@dataclass
class Network:
    """Successive shortest paths with potentials over integer capacities."""

    n: int
    to: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.out = [[] for _ in range(self.n)]

    def arc(self, u: int, v: int, room: int, cost: int) -> int:
        for x, y, r, c in ((u, v, room, cost), (v, u, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y), self.room.append(r), self.cost.append(c)
        return len(self.to) - 2

    def route(self, source: int, sink: int) -> None:
        """All flow of least cost.

        For each distance of the sink, the arcs on shortest paths are filled by
        blocking flows; costs are few small numbers, so there are few distances.
        """
        price = [0] * self.n
        while True:
            dist: list[int | None] = [None] * self.n
            heap = [(0, source)]
            dist[source] = 0
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for a in self.out[u]:
                    v = self.to[a]
                    if self.room[a] > 0:
                        nd = d + self.cost[a] + price[u] - price[v]
                        if dist[v] is None or nd < dist[v]:
                            dist[v] = nd
                            heapq.heappush(heap, (nd, v))
            if dist[sink] is None:
                return
            far = max(d for d in dist if d is not None)
            price = [p + (far if d is None else d) for p, d in zip(price, dist, strict=True)]
            while self._fill(source, sink, price):
                pass

    def _fill(self, source: int, sink: int, price: list[int]) -> bool:
        """A blocking flow over arcs of reduced cost 0; false if the sink isn't reached."""
        free = lambda a, u: self.room[a] > 0 and self.cost[a] + price[u] == price[self.to[a]]
        level, queue = {source: 0}, [source]
        for u in queue:
            for a in self.out[u]:
                v = self.to[a]
                if v not in level and free(a, u):
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return False
        tried, path, u = dict.fromkeys(level, 0), [], source
        while True:
            if u == sink:
                push = min(self.room[a] for a in path)
                for a in path:
                    self.room[a] -= push
                    self.room[a ^ 1] += push
                # go on from the tail of the first arc that is full
                k = next(i for i, a in enumerate(path) if not self.room[a])
                u = self.to[path[k] ^ 1]
                del path[k:]
                continue
            arcs = self.out[u]
            while tried[u] < len(arcs):
                a = arcs[tried[u]]
                if level.get(self.to[a]) == level[u] + 1 and free(a, u):
                    break
                tried[u] += 1
            if tried[u] < len(arcs):
                path.append(arcs[tried[u]])
                u = self.to[path[-1]]
            elif path:
                u = self.to[path.pop() ^ 1]
                tried[u] += 1
            else:
                return True


def route_tokens(patterns: list[tuple[tuple, int]], quotas: dict, costs: tuple[int, ...] = REPEAT_COSTS) -> list[dict]:
    """Tokens that each pattern gives to each of its sources, at least cost."""
    sources = list(quotas)
    net = Network(len(patterns) + len(sources) + 2)
    start, end = net.n - 2, net.n - 1
    place = {s: len(patterns) + i for i, s in enumerate(sources)}
    for s in sources:
        net.arc(place[s], end, quotas[s], 0)
    given = []
    for p, (members, size) in enumerate(patterns):
        for c in costs:
            net.arc(start, p, size, c)
        given.append({s: net.arc(p, place[s], len(costs) * size, 0) for s in members})
    net.route(start, end)
    return [{s: net.room[a ^ 1] for s, a in arcs.items() if net.room[a ^ 1]} for arcs in given]


def cycle_weights(sources: list, cycle: tuple[int, ...] = (1, 2, 3)) -> dict:
    """Weights 1, 2, 3, repeating, over sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def _pattern_key(pattern: Column) -> Column:
    """A pattern as text that tells null from every name; arrays don't join on nulls."""
    return F.to_json(F.struct(F.transform(pattern, lambda s: F.struct(s.isNull().alias("n"), F.coalesce(s.cast("string"), F.lit("")).alias("s"))).alias("p")))


def _placed(docs: DataFrame, membership: Column, seed: int) -> DataFrame:
    """Adds the pattern, its key __mix_p, and the seeded order __mix_h.

    The order is a digest of seed, id and text, so rows that share an id or
    lack one are still told apart; __mix_draw (0 to 1) tells equal rows apart.
    """
    marked = docs.withColumn("__mix_pattern", F.array_sort(F.array_distinct(membership)))
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    return marked.withColumns({"__mix_p": _pattern_key(F.col("__mix_pattern")), "__mix_h": h, "__mix_draw": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / (1 << 30)})


#: What is kept of a row to find the rules.
SLIM = ("__mix_size", "__mix_pattern", "__mix_p", "__mix_h", "__mix_draw")


def _rules(sized: DataFrame, weights) -> DataFrame:
    """One row for each pattern: what the flow takes of it, and where it cuts the seeded order."""
    rows = sized.groupBy("__mix_pattern").agg(F.sum("__mix_size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    name = lambda s: (s is None, s or "")
    patterns = sorted(((tuple(r["__mix_pattern"]), r["size"]) for r in rows), key=lambda p: [name(s) for s in p[0]])
    sources = sorted({s for p, _ in patterns for s in p}, key=name)
    sizes = dict.fromkeys(sources, 0)
    for p, n in patterns:
        for s in p:
            sizes[s] += n
    weight = weights(sources)
    total, held = sum(n for _, n in patterns), sum(sizes.values())
    shares = fill_targets([sizes[s] for s in sources], [weight[s] for s in sources])
    targets = {s: x * (total / held if held != total else 1) for s, x in zip(sources, shares, strict=True)}
    flows = route_tokens(patterns, {s: int(targets[s]) for s in sources})
    schema = T.StructType(
        [
            T.StructField("__mix_pattern", sized.schema["__mix_pattern"].dataType),
            T.StructField("__mix_whole", T.LongType()),
            T.StructField("__mix_rest", T.LongType()),
            T.StructField("__mix_source_size", T.ArrayType(T.LongType())),
            T.StructField("__mix_target", T.ArrayType(T.DoubleType())),
        ]
    )
    given = [sum(f.values()) for f in flows]
    plan = [(list(p), x // n if n else 0, x % n if n else 0, [sizes[s] for s in p], [targets[s] for s in p]) for (p, n), x in zip(patterns, given, strict=True)]
    plan = sized.sparkSession.createDataFrame(plan, schema).withColumn("__mix_p", _pattern_key(F.col("__mix_pattern")))
    # the cell in which a pattern's share is reached, then the place in it; equal rows are one step
    own = sized.where("__mix_size > 0")
    cut = plan.select("__mix_p", F.lit("").alias("cell"), F.lit(0).cast("long").alias("b0"), F.col("__mix_rest").alias("rest"))
    before = Window.partitionBy("__mix_p").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    within = 0
    for digits in CELL_DIGITS:
        inside = own.withColumn("cell", F.substring("__mix_h", 1, within)).join(F.broadcast(cut), ["__mix_p", "cell"])
        cells = inside.groupBy("__mix_p", F.substring("__mix_h", 1, digits).alias("cell")).agg(F.sum("__mix_size").alias("b"), F.first("b0").alias("b0"), F.first("rest").alias("rest"))
        reached = cells.withColumn("at", F.col("b0") + F.coalesce(F.sum("b").over(before), F.lit(0))).where("at < rest")
        cut = staged(reached.groupBy("__mix_p").agg(F.max("cell").alias("cell"), F.max_by("at", "cell").alias("b0"), F.first("rest").alias("rest")), "cut")
        within = digits
    edge = own.withColumn("cell", F.substring("__mix_h", 1, within)).join(F.broadcast(cut), ["__mix_p", "cell"]).groupBy("__mix_p", "__mix_h").agg(F.sum("__mix_size").alias("n"), F.max("__mix_size").alias("one"), F.first("b0").alias("b0"), F.first("rest").alias("rest"))
    in_cell = Window.partitionBy("__mix_p").orderBy("__mix_h").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("at", F.col("b0") + F.coalesce(F.sum("n").over(in_cell), F.lit(0)))
    # a row is taken if more than half of it fits; of equal rows, the share that fits
    fits = F.when(F.col("n") == F.col("one"), (F.col("at") + F.col("n") / 2 <= F.col("rest")).cast("double")).otherwise((F.col("rest") - F.col("at")) / F.col("n"))
    last = edge.where("at < rest").groupBy("__mix_p").agg(F.max("__mix_h").alias("__mix_last"), F.max_by(F.least(fits, F.lit(1.0)), "__mix_h").alias("__mix_share"))
    return plan.drop("__mix_pattern").join(last, "__mix_p", "left")


def _copies() -> Column:
    """How often a document is taken: a comparison with its pattern's cut."""
    once_more = (F.col("__mix_h") < F.col("__mix_last")) | ((F.col("__mix_h") == F.col("__mix_last")) & (F.col("__mix_draw") < F.col("__mix_share")))
    return F.col("__mix_whole") + F.coalesce(once_more, F.lit(False)).cast("long")


def mix_to_weights(docs: DataFrame, membership: Column, weights=cycle_weights, seed: int = 17) -> DataFrame:
    """Take documents so that the sources' tokens come near their targets.

    ``membership`` is each document's array of sources, ``weights`` maps the
    list of sources to a weight each.  A source's size is the tokens of all
    documents that it holds, and the targets share the tokens of all documents.
    Returns doc_id, size, pattern, source_size and target (arrays in the
    pattern's order), taken.

    Null text has size 0 and nothing is taken of it; a null source is a source
    of its own.  The seeded order is one of id and text; rows that repeat both
    follow each other in it, and where the cut falls among them, a share of
    them is taken by their place in the table, so reruns over the same files
    agree.  An empty table gives no rows; a text of any length is counted
    whole; other columns are not read, whatever their names.
    """
    sized = _placed(docs, membership, seed).withColumn("__mix_size", n_words(F.col("text"))).select("doc_id", *SLIM)
    sized = staged(sized, "sizes")  # the texts are read once
    # one row for each pattern, whose number is checked
    return sized.join(F.broadcast(_rules(sized, weights)), "__mix_p").select(
        "doc_id", F.col("__mix_size").alias("size"), F.col("__mix_pattern").alias("pattern"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (_copies() * F.col("__mix_size")).alias("taken")
    )


def take_mix(docs: DataFrame, membership: Column, weights=cycle_weights, seed: int = 17) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns.

    Documents without words are not taken.  Texts aren't shuffled: each row
    is compared with the cut of its pattern.  Nulls, ties, repeated rows and
    empty tables as in :func:`mix_to_weights`.
    """
    placed = _placed(docs, membership, seed)
    sized = staged(placed.withColumn("__mix_size", n_words(F.col("text"))).select("doc_id", *SLIM), "sizes")
    rules = staged(_rules(sized, weights), "rules")
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    taken = placed.where(some).join(F.broadcast(rules), "__mix_p").select(*(F.col(f"`{c}`") for c in docs.columns), _copies().alias("__mix_copies")).where("__mix_copies > 0")
    return taken.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
