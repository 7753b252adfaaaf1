"""The compiler: scopes, shapes and rewrites over the relational values.

Rewrites made here because Catalyst can't: aggregates of group members fuse
into one aggregation, flat traversals are plain joins, existence tests become
semi and anti joins, per-parent order and slice become ranked windows, and
per-parent aggregates are joined by key after aggregation.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import FUNCTIONS, METHODS, Function
from tessera.functions import collections as C
from tessera.functions import times
from tessera.language import ast as A
from tessera.language.lexer import QueryError
from tessera.operators import tables
from tessera.operators.positions import numbered, ranks
from tessera.operators.shared import cut
from tessera.plans.values import Fn, GroupScope, Link, Rel, Scope, Val, fresh, sorting
from tessera.sources.catalog import Catalog

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
CASTS = {
    "i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "isize": "bigint", "usize": "bigint", "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)",
    "i128": "decimal(38,0)", "u128": "decimal(38,0)", "f16": "float", "f32": "float", "f64": "double", "f128": "double", "bool": "boolean", "str": "string", "string": "string", "String": "string",
    "char": "string", "date": "date", "Date": "date", "DateTime": "timestamp", "Timestamp": "timestamp", "Decimal": "decimal(38,10)",
}
_RETURNS = {"double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType(), "date": T.DateType()}


class Compiler:
    def __init__(self, catalog: Catalog, functions: dict[str, Any] | None = None):
        self.catalog, self.spark = catalog, catalog.spark
        self.user = functions or {}

    # ------------------------------------------------------------ queries
    def query(self, node: A.Node, env: dict | None = None, scope: Scope | None = None):
        if isinstance(node, A.SelectQuery):
            return self.select(node, env or {}, scope)
        return self.ev(node, env or {}, scope or self.unit())

    def unit(self) -> Scope:
        out = Scope(self.spark.range(1))
        out.is_unit = True
        return out

    def table(self, head: A.Head) -> tuple[DataFrame, Column | None]:
        """Rows of a head's types as one struct column, and the id in it."""
        col = fresh(head.binder or head.label or "t")
        parts = [self.catalog[t] for t in head.types]
        if len(parts) == 1:
            df = parts[0].edges() if parts[0].is_edge else parts[0].df
            key = parts[0].id
        else:
            frames = []
            for p in parts:
                f = p.edges() if p.is_edge else p.df
                f = f.withColumnRenamed(p.id, "_id") if p.id else f
                frames.append(f.withColumn("_type", F.lit(p.name)))
            df = frames[0]
            for f in frames[1:]:
                df = df.unionByName(f, allowMissingColumns=True)
            key = "_id" if parts[0].id else None
        df = df.select(F.struct(*df.columns).alias(col))
        return df, (F.col(col)[key] if key else None), col

    def root(self, head: A.Head, env: dict, scope: Scope | None) -> Rel:
        if not head.types:
            value = env.get(head.label)
            if not isinstance(value, Rel):
                raise QueryError(f"{head.label} is no collection; a root needs a type, as in {head.label}:Type")
            rel = value.but(iterating=False)
        else:
            df, key, col = self.table(head)
            rel = Rel(df, Val(F.col(col), df.schema[col].dataType))
            rel.elem.key = key
            rel.elem.id, rel.elem.rows = self.catalog[head.types[0]].id, lambda: df
            if head.record is not None:
                rel = rel.but(df=rel.df.where(key == F.lit(head.record.value)))
        names = tuple(n for n in (head.binder, head.label) if n)
        rel = rel.but(names=names[:1] or names, env={**rel.env, **({head.binder: rel.elem} if head.binder else {})})
        return self.modified(rel, head.mods, env, scope)

    def modified(self, rel: Rel, mods: A.Modifiers, env: dict, scope: Scope | None) -> Rel:
        if mods.where is not None:
            rel = self.where(rel, mods.where, env, scope)
        if mods.order:
            rel = self.ordered(rel, mods.order, env)
        if mods.range is not None:
            rel = self.sliced(rel, mods.range, env, scope)
        return rel

    def select(self, q: A.SelectQuery, env: dict, scope: Scope | None):
        roots: dict[str, Rel] = {}
        for head in q.roots:
            rel = self.root(head, env, scope)
            roots[head.label or head.binder] = rel
        labels: dict[str, Any] = {}
        for path in q.paths:
            self.attach_path(path, roots, labels, env, q.inner)
        if q.inner:
            for name, rel in roots.items():
                for link in rel.elem.links.values():
                    rows = link.make()
                    key = fresh("k")
                    rel = rel.but(df=rel.df.join(rows.df.select(F.col(rows.pk[0]).alias(key)), link.key == F.col(key), "left_semi"))
                roots[name] = rel
        for label, mods in q.blocks:
            if label not in roots:
                raise QueryError(f"for {label}: no such root")
            roots[label] = self.modified(roots[label], mods, {**env, **roots}, scope)
        only = next(iter(roots))
        env = {**env, **roots}
        if q.where is not None:
            roots[only] = self.where(roots[only], q.where, env, scope)
        if q.groups:
            for keys, name in q.groups:
                target = self.group_target(keys, roots) if len(roots) > 1 else only
                env[name] = self.grouped(roots[target], keys, env, label=target)
            first = q.groups[0][1]
            if q.order or q.range:
                uses = {n.name for k in q.order for n in _names(k.expr)}
                if first in uses or any(k in uses for k, _ in q.groups[0][0].fields if not set(roots[only].names) & uses):
                    env[first] = self.modified(env[first].but(names=(first,)), A.Modifiers(None, q.order, q.range), env, scope)
                else:
                    roots[only] = self.modified(roots[only], A.Modifiers(None, q.order, q.range), env, scope)
                    env[first] = self.grouped(roots[only], q.groups[0][0], env, label=only)
        else:
            roots[only] = self.modified(roots[only], A.Modifiers(None, q.order, q.range), env, scope)
        scope = scope or self.unit()
        scope.joins = scope.is_unit
        return self.ev(q.projection, {**env, **roots}, scope)

    def group_target(self, keys: A.ObjectOf, roots: dict[str, Rel]) -> str:
        """The root whose binder the keys name; of constant keys, the first."""
        used = {n.name for _, e in keys.fields for n in _names(e)}
        named = [label for label, rel in roots.items() if set(rel.names) & used]
        if len(named) > 1:
            raise QueryError("the keys of a group name the binders of several roots")
        return named[0] if named else next(iter(roots))

    # ------------------------------------------------------------ links
    def attach_path(self, path: A.Path, roots: dict, labels: dict, env: dict, inner: bool) -> None:
        """Hang a path's hops below the element that its base names."""
        name = path.base.label or path.base.binder
        holder = roots[name].elem if name in roots else labels.get(name)
        if holder is None:
            found = next((r for r in roots.values() if name in r.names), None)
            if found is None:
                raise QueryError(f"a path must start at a root or an earlier label, not {name}")
            holder = found.elem
        gate = path.base.mods.where
        binder = path.base.binder or (roots[name].names[0] if name in roots and roots[name].names else name)
        self.hop(holder, list(path.hops), labels, env, gate, binder)

    def hop(self, holder, hops: list[A.Hop], labels: dict, env: dict, gate, binder) -> None:
        """``holder`` is a Val, or a placeholder of an earlier label, that gets the link."""
        if not hops:
            return
        hop, rest = hops[0], hops[1:]
        edge, target = hop.edge, hop.target
        label = (edge.label or edge.binder) if edge and (edge.label or edge.binder or edge.types) else (target.label or target.binder)
        below = _Pending()
        if target is not None:
            for n in (target.label, target.binder):
                if n:
                    labels[n] = below
        if label in holder.links and isinstance(holder, Val) and holder.type and label in getattr(holder.type, "names", ()):
            raise QueryError(f"the link {label} has the name of a field")

        def make(element: Val) -> Link:
            return self.link(element, hop, label, below, env, gate, binder)

        previous = holder.links.get(label)
        if isinstance(holder, _Pending):
            holder.links[label] = make
        else:
            holder.links[label] = _merged(previous, make(holder)) if previous is not None else make(holder)
        if target is not None and rest:
            self.hop(below, rest, labels, env, None, None)

    def link(self, element: Val, hop: A.Hop, label: str, below: _Pending, env: dict, gate, binder) -> Link:
        key = getattr(element, "key", None)
        edge, target = hop.edge, hop.target
        if edge is None or not edge.types:
            # a node-to-node hop: every target is attached to every element
            def every() -> Rel:
                rel = self.root(target, env, None)
                rel.df = rel.df.withColumn(pk := fresh("p"), F.lit(1))
                return rel.but(pk=(pk,))

            return Link(label, F.lit(1), every)
        if key is None:
            raise QueryError(f"{label}: only documents with an id can be linked")

        def rows() -> Rel:
            df, _, col = self.table(edge)
            e = F.col(col)
            forms = []
            if hop.direction in ("->", "<->"):
                forms.append((e["_from"], e["_to"], None))
            if hop.direction in ("<-", "<->"):
                forms.append((e["_to"], e["_from"], (e["_from"] != e["_to"]) if hop.direction == "<->" else None))
            pk, end = fresh("p"), fresh("q")
            frames = [(df.where(c) if c is not None else df).select(col, near.alias(pk), far.alias(end)) for near, far, c in forms]
            steps = frames[0].unionAll(frames[1]) if len(frames) == 2 else frames[0]
            if hop.hops is not None:
                steps = self.expanded(steps, pk, end, col, hop.hops)
            rel = Rel(steps, Val(F.col(col), steps.schema[col].dataType), pk=(pk,), names=(edge.binder or label,))
            rel.env = {edge.binder: rel.elem} if edge.binder else {}
            if edge.mods.where is not None:
                rel = self.where(rel, edge.mods.where, env, None)
            if gate is not None:
                # filters of the base gate the traversal and keep the base's rows
                base_key = fresh("k")
                base = Rel(element.rows().select(element.col.alias(base_key)), Val(F.col(base_key), element.type))
                base.elem.key = F.col(base_key)[element.id]
                base.env, base.names = {binder: base.elem}, (binder,)
                kept = self.where(base, gate, env, None).df.select(F.col(base_key)[element.id].alias(k := fresh("k"))).distinct()
                rel = rel.but(df=rel.df.join(kept, F.col(pk) == F.col(k), "left_semi"))
            rel = self.modified(rel, A.Modifiers(None, edge.mods.order, edge.mods.range), env, None) if edge.mods.order or edge.mods.range else rel
            if target is not None:
                rel.elem.links[target.label or target.binder] = self.endpoint(rel, end, target, below, env)
                if target.binder and target.binder != target.label:
                    rel.elem.links.setdefault(target.binder, rel.elem.links[target.label or target.binder])
            return rel

        return Link(label, key, rows)

    def endpoint(self, edges: Rel, end: str, target: A.Head, below: _Pending, env: dict) -> Link:
        def rows() -> Rel:
            if not target.types:
                raise QueryError(f"{target.label}: an endpoint needs a type")
            df, key, col = self.table(target)
            df = df.withColumn(pk := fresh("p"), key)
            rel = Rel(df, Val(F.col(col), df.schema[col].dataType), pk=(pk,), names=(target.binder or target.label,))
            rel.elem.key = key
            rel.elem.id = self.catalog[target.types[0]].id
            rel.elem.rows = lambda: df
            rel.env = {target.binder: rel.elem} if target.binder else {}
            for name, make in below.links.items():
                rel.elem.links[name] = make(rel.elem)
            return self.modified(rel, target.mods, env, None)

        return Link(target.label or target.binder, F.col(end), rows)

    def expanded(self, steps: DataFrame, pk: str, end: str, col: str, span: A.RangeOf) -> DataFrame:
        """Walks of bounded length: unrolled joins, one row for each walk."""
        bound = lambda n, d: d if n is None else int(n.value)
        lo, hi = bound(span.start, 1), bound(span.end, None)
        if hi is None:
            return self.reached(steps, pk, end, col, lo)
        hi = hi if span.inclusive else hi - 1
        walk, out = steps, []
        for n in range(1, hi + 1):
            if n >= lo:
                out.append(walk)
            if n < hi:
                a, b = fresh("x"), fresh("y")
                nxt = steps.select(F.col(col), F.col(pk).alias(a), F.col(end).alias(b))
                walk = walk.select(F.col(pk), F.col(end)).join(nxt, F.col(end) == F.col(a)).select(col, F.col(pk), F.col(b).alias(end))
        df = out[0]
        for x in out[1:]:
            df = df.unionAll(x)
        return df

    @staticmethod
    def reached(steps: DataFrame, pk: str, end: str, col: str, lo: int) -> DataFrame:
        """Walks without an end: every node once for each start, by its first
        step, so cycles end.  Each round is written to the shared folder."""
        a, b = fresh("x"), fresh("y")
        nxt = steps.select(F.col(col), F.col(pk).alias(a), F.col(end).alias(b))
        front = seen = cut(steps.dropDuplicates([pk, end]).select(col, pk, end, F.lit(1).alias("__hops")))
        n = 1
        while not front.isEmpty():
            n += 1
            walk = front.select(pk, end).join(nxt, F.col(end) == F.col(a)).select(col, pk, F.col(b).alias(end)).dropDuplicates([pk, end])
            front = cut(walk.join(seen.select(pk, end), [pk, end], "left_anti").select(col, pk, end, F.lit(n).alias("__hops")))
            seen = seen.unionAll(front)
        return seen.where(F.col("__hops") >= lo).drop("__hops")

    def follow(self, rel: Rel, link: Link) -> Rel:
        """Flat traversal: rows of the link joined to the rows at hand, nothing nested."""
        rows = link.make()
        pk = rows.pk[0]
        df = rel.df.join(rows.df, link.key == F.col(pk)).drop(pk)
        names = (rel.walked_as,) if rel.walked_as else rows.names
        env = {**rel.env, **dict.fromkeys(rel.names, rel.elem), **rows.env, **dict.fromkeys(names, rows.elem)}
        return Rel(df, rows.elem, env, rel.pk, rel.outer, (*rel.order, *rows.order) if rel.order else (), names, True)

    # ------------------------------------------------------------ relational steps
    def in_rows(self, rel: Rel, env: dict) -> dict:
        own = {n: rel.elem for n in rel.names}
        return {**env, **rel.env, **own}

    def scoped(self, rel: Rel) -> Scope:
        return rel.group_scope if rel.group_scope is not None else Scope(rel.df)

    def plain(self, rel: Rel) -> Rel:
        """Groups as rows: the aggregation is built."""
        scope = rel.group_scope
        if scope is None:
            return rel
        return rel.but(df=scope.build(), group_scope=None)

    def where(self, rel: Rel, cond: A.Node, env: dict, scope: Scope | None) -> Rel:
        if rel.group is not None and rel.group_scope is None:
            v = self.ev(cond, self.in_rows(rel, env), Scope(rel.df))
            new = F.coalesce(v.col, F.lit(False))
            return rel.but(cond=new if rel.cond is None else rel.cond & new, iterating=True)
        if rel.group_scope is not None:
            gs = rel.group_scope
            v = self.ev(cond, self.in_rows(rel, env), gs)
            gs.steps.append(lambda df: df.where(v.col))
            return self._kept(rel, rel.but(iterating=True))
        for part in _conjuncts(cond):
            rel = self._where_one(rel, part, env, scope)
        return rel.but(iterating=True)

    def _where_one(self, rel: Rel, cond: A.Node, env: dict, scope: Scope | None) -> Rel:
        inner = self.in_rows(rel, env)
        keys = self._correlation(rel, cond, env, inner, scope)
        if keys is not None:
            own, other = keys
            pk = fresh("p")
            return rel.but(df=rel.df.withColumn(pk, own.col), pk=(*rel.pk, pk), outer=(*rel.outer, other.col))
        row = Scope(rel.df)
        semi = self._existence(cond, inner, row)
        if semi is not None:
            sub, kind = semi
            if sub.pk:
                names = [fresh("k") for _ in sub.pk]
                right = sub.df.select(*(F.col(p).alias(n) for p, n in zip(sub.pk, names, strict=True)))
                on = None
                for o, n in zip(sub.outer, names, strict=True):
                    on = (o == F.col(n)) if on is None else on & (o == F.col(n))
                return rel.but(df=row.df.join(right, on, kind))
        v = self.ev(cond, inner, row)
        if isinstance(v, Rel):
            raise QueryError("a condition must be one value")
        kept = row.df.where(v.col)
        return rel.but(df=kept)

    def _correlation(self, rel: Rel, cond: A.Node, env: dict, inner: dict, scope: Scope | None):
        """(inner, outer) of an equality between these rows and the scope around."""
        if scope is None or not isinstance(cond, A.Binary) or cond.op != "==":
            return None
        own = {n for n in rel.names} | set(rel.env)
        around = {k for k, v in env.items() if isinstance(v, Val)} - own
        sides = [{n.name for n in _names(e)} for e in (cond.left, cond.right)]
        for (mine, theirs), (a, b) in (((0, 1), (cond.left, cond.right)), ((1, 0), (cond.right, cond.left))):
            if sides[mine] & own and not sides[mine] & around and sides[theirs] & around and not sides[theirs] & own:
                return self.ev(a, inner, Scope(rel.df)), self.ev(b, env, scope)
        return None

    def _existence(self, cond: A.Node, env: dict, row: Scope):
        """A correlated relation and the join of any, none, all, is_empty and their negations."""
        flip = False
        while isinstance(cond, A.Unary) and cond.op == "!":
            cond, flip = cond.arg, not flip
        if isinstance(cond, A.Call) and isinstance(cond.fn, A.Name) and cond.fn.name in ("any", "none", "all", "is_empty") and cond.args:
            cond = A.Method(cond.args[0], cond.fn.name, cond.args[1:])
        if not isinstance(cond, A.Method) or cond.name not in ("any", "none", "all", "is_empty"):
            return None
        base = self.ev(cond.base, env, row)
        if not isinstance(base, Rel) or base.group is not None or not base.pk:
            return None
        sub = self.tested(base, cond, env)
        positive = (cond.name == "any") != flip
        return sub, "left_semi" if positive else "left_anti"

    def tested(self, rel: Rel, call: A.Method, env: dict) -> Rel:
        """Rows that make ``any`` true, or ``all``, ``none`` and ``is_empty`` false."""
        if not call.args:
            return rel
        row = Scope(rel.df)
        p = self.apply(self.ev(call.args[0], env, row), [rel.elem], row)
        # a filter drops nulls by itself, and a bare predicate reaches the scan
        return rel.but(df=row.df.where(~F.coalesce(p.col, F.lit(False)) if call.name == "all" else p.col))

    def ordered(self, rel: Rel, keys: tuple, env: dict) -> Rel:
        gs = rel.group_scope
        row = gs or Scope(rel.df)
        inner, cols = self.in_rows(rel, env), []
        for k in keys:
            v = self.ev(k.expr, inner, row)
            cols.append((v.col, k.descending))
        out = rel.but(order=tuple(cols), iterating=True) if gs else self.unfused(rel).but(df=row.df, order=tuple(cols), iterating=True)
        return self._kept(rel, out)

    def unfused(self, rel: Rel) -> Rel:
        """Members as ordinary rows, for what an aggregation can't hold."""
        if rel.group is None:
            return rel
        df = rel.df.where(rel.cond) if rel.cond is not None else rel.df
        return rel.but(df=df, group=None, cond=None)

    @staticmethod
    def _kept(old: Rel, new: Rel) -> Rel:
        if old.group_scope is not None:
            new.group_scope = old.group_scope
        return new

    def bounds(self, span: A.RangeOf, env: dict, scope: Scope | None):
        ends = []
        # bounds of whole collections are scalar subqueries, not columns of the result's row
        scope = self.unit() if scope is None or scope.is_unit else scope
        for e in (span.start, span.end):
            v = None if e is None else self.ev(e, env, scope)
            ends.append(v)
        a, b = ends
        if b is not None and span.inclusive:
            b = Val(b.col + 1, b.type, literal=None if b.literal is None else b.literal + 1)
        return a, b

    def sliced(self, rel: Rel, span: A.RangeOf, env: dict, scope: Scope | None) -> Rel:
        a, b = self.bounds(span, env, scope)
        gs = rel.group_scope
        lit = lambda v, d: d if v is None else v.literal
        start, end = lit(a, 0), lit(b, -1)
        if gs is not None:
            rel = self.plain(rel)
        rel = self.unfused(rel)
        plain = not rel.pk and start is not None and end is not None and start >= 0 and (b is None or end >= 0)
        if plain:
            df = rel.df.orderBy(*sorting(rel.order)) if rel.order else rel.df
            df = df.offset(start) if start else df
            if b is not None:
                df = df.limit(max(0, end - start))
            return rel.but(df=df, iterating=True)
        n = fresh("n")
        if not rel.pk:
            return self.cut(rel, a, b)
        w = Window.partitionBy(*rel.pk)
        # ranks from 1, compared as they are: Catalyst then keeps k rows of a key on the map side
        df = rel.df.withColumn(n, F.row_number().over(w.orderBy(*sorting(rel.order))))
        size = F.count("*").over(w)
        place = lambda v: v.col if v.literal is None or v.literal >= 0 else size + v.col
        if a is not None and start != 0:
            df = df.withColumn(n + "a", F.col(n) > place(a)).where(n + "a").drop(n + "a") if start is None or start < 0 else df.where(F.col(n) > start)
        if b is not None:
            if end is not None and end >= 0:
                df = df.where(F.col(n) <= end)
            else:
                df = df.withColumn(n + "b", F.col(n) <= place(b)).where(n + "b").drop(n + "b")
        return rel.but(df=df.drop(n), iterating=True)

    def placed(self, rel: Rel) -> tuple[Rel, str]:
        """Rows of a whole collection with their 0-based position in its order."""
        n, v = fresh("n"), fresh("v")
        keys = [(fresh("o"), c, down) for c, down in rel.order]
        df = rel.df.withColumns({v: rel.elem.col, **{k: c for k, c, _ in keys}})
        df = numbered(df, sorting(tuple((F.col(k), down) for k, _, down in keys)) if keys else [], n)
        elem = _copy(rel.elem, col=F.col(v))
        return rel.but(df=df, elem=elem, order=((F.col(n), False),), iterating=True), n

    def cut(self, rel: Rel, a: Val | None, b: Val | None) -> Rel:
        """A slice of a whole collection by positions, for ends that are
        computed or count from the end."""
        rel, n = self.placed(rel)
        size = rel.df.agg(F.count("*")).scalar()
        place = lambda v: F.when(v.col < 0, size + v.col).otherwise(v.col)
        df = rel.df
        if a is not None:
            df = df.where(F.col(n) >= place(a))
        if b is not None:
            df = df.where(F.col(n) < place(b))
        return rel.but(df=df)

    def grouped(self, rel: Rel, keys: A.ObjectOf, env: dict, label: str | None = None) -> Rel:
        rel = self.unfused(self.plain(rel))
        row = Scope(rel.df)
        inner = self.in_rows(rel, env)
        fields = []
        for name, node in keys.fields:
            v = self.ev(node, inner, row)
            if isinstance(v, Rel) or isinstance(row.type_of(v), (T.ArrayType, T.MapType)):
                raise QueryError(f"the group key {name} must be one value")
            fields.append((name, v))
        pk = [(p, Val(F.col(p))) for p in rel.pk]
        scope = GroupScope(rel.but(df=row.df), pk + fields)
        cols = list(zip(scope.names, scope.keys, scope.types, strict=True))[len(pk) :]
        struct = F.struct(*(F.col(k).alias(n) for n, k, _ in cols))
        elem = Val(struct, T.StructType([T.StructField(n, t) for n, _, t in cols]))
        elem.members = {label or "items": scope.members, "items": scope.members}
        for n in rel.names:
            elem.members.setdefault(n, scope.members)
        elem.group = scope
        elem.key_fields = {n: Val(F.col(k), t) for n, k, t in cols}
        out = Rel(self.spark.range(0), elem, {}, tuple(scope.keys[: len(pk)]), rel.outer)
        out.group_scope = scope
        return out

    def mapped(self, rel: Rel, body, env: dict) -> Rel:
        """A new element for each row; ``body(env, scope)`` builds it."""
        gs = rel.group_scope
        row = gs or Scope(rel.df)
        v = body(self.in_rows(rel, env), row)
        if isinstance(v, Rel):
            if v.group is not None or v.pk:
                v = self.nest(v, row)
            else:
                v = self.nest(v, row)
        out = rel.but(elem=v, iterating=True) if gs or rel.group is not None else rel.but(df=row.df, elem=v, iterating=True)
        return self._kept(rel, out)

    # ------------------------------------------------------------ rows to values
    def filtered_elem(self, rel: Rel) -> Column:
        return rel.elem.col if rel.cond is None else F.when(rel.cond, rel.elem.col)

    def nest(self, rel: Rel, scope: Scope) -> Val:
        """The elements as an array column, in order, empty rather than null."""
        rel = self.plain(rel)
        elem = self.filtered_elem(rel)
        if rel.order:
            rel = self.unfused(rel)
            if rel.pk:
                n = fresh("n")
                rel = rel.but(df=rel.df.withColumn(n, F.row_number().over(Window.partitionBy(*rel.pk).orderBy(*sorting(rel.order)))))
            else:
                rel, n = self.placed(rel)
            elem = rel.elem.col
            pairs = F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), elem.alias("v"))))
            agg = F.transform(pairs, lambda p: p["v"])
        elif rel.cond is not None:
            agg = F.transform(F.collect_list(F.when(rel.cond, F.struct(rel.elem.col.alias("v")))), lambda p: p["v"])
        else:
            agg = F.collect_list(F.struct(elem.alias("v")))
            agg = F.transform(agg, lambda p: p["v"])
        (col,) = scope.reduce(rel, [agg], array=True)
        kind = rel.elem.type or (rel.df.select(rel.elem.col.alias("x")).schema["x"].dataType if rel.group is None else rel.group.base.select(rel.elem.col.alias("x")).schema["x"].dataType)
        arr = T.ArrayType(kind)
        return Val(F.coalesce(col, F.array().cast(arr)), arr)

    def aggregate(self, rel: Rel, name: str, scope: Scope, extra: tuple = ()) -> Val:
        rel = self.plain(rel)
        x = self.filtered_elem(rel)
        one = F.lit(1) if rel.cond is None else F.when(rel.cond, 1)
        num = T.DoubleType()
        if name in ("len", "count"):
            (c,) = scope.reduce(rel, [F.count(one)])
            return Val(F.coalesce(c, F.lit(0)), T.LongType())
        if name == "is_empty":
            (c,) = scope.reduce(rel, [F.count(one)])
            return Val(F.coalesce(c, F.lit(0)) == 0, T.BooleanType())
        kind = rel.elem.type
        if name == "sum":
            (c,) = scope.reduce(rel, [F.sum(x)])
            return Val(F.coalesce(c, F.lit(0)), T.LongType() if isinstance(kind, INTEGERS) else kind)
        simple = {
            "min": F.min, "max": F.max, "avg": F.avg, "mean": F.avg, "variance": F.var_samp, "stddev": F.stddev_samp, "median": F.median, "count_distinct": F.count_distinct,
            "approx_count_distinct": F.approx_count_distinct,
        }
        if name in simple:
            (c,) = scope.reduce(rel, [simple[name](x)])
            return Val(c, kind if name in ("min", "max") else num)
        if name == "quantile":
            (c,) = scope.reduce(rel, [F.percentile(x, extra[0].col)])
            return Val(c, num)
        if name == "approx_quantile":
            (c,) = scope.reduce(rel, [F.percentile_approx(x, extra[0].col)])
            return Val(c)
        if name in ("correlation", "covariance", "linear_regression"):
            a, b = (F.when(rel.cond, v) if rel.cond is not None else v for v in (self.apply(extra[i], [rel.elem], Scope(rel.df)).col for i in (0, 1)))
            if name == "linear_regression":
                cs = scope.reduce(rel, [F.regr_slope(b, a), F.regr_intercept(b, a), F.regr_r2(b, a)])
                return Val(F.struct(cs[0].alias("slope"), cs[1].alias("intercept"), cs[2].alias("r2")))
            (c,) = scope.reduce(rel, [(F.corr if name == "correlation" else F.covar_samp)(a, b)])
            return Val(c, num)
        raise QueryError(f"unknown aggregate {name}")

    def picked(self, rel: Rel, n: int, scope: Scope, required: bool) -> Val:
        """The n-th element as one value; from the end if negative."""
        rel = self.unfused(self.plain(rel))
        order, place = rel.order, n
        if n < 0:
            order, n = tuple((c, not down) for c, down in order), -n - 1
        if rel.pk:
            k = fresh("n")
            w = Window.partitionBy(*rel.pk).orderBy(*sorting(order))
            df = rel.df.withColumn(k, F.row_number().over(w)).where(F.col(k) == n + 1).drop(k)
        else:
            df = (rel.df.orderBy(*sorting(order)) if order else rel.df).offset(n).limit(1)
        (c,) = scope.reduce(rel.but(df=df), [F.collect_list(F.struct(rel.elem.col.alias("v")))], array=True)
        found = F.try_element_at(c, F.lit(1))
        if required:
            found = F.element_at(F.when(F.size(c) > 0, c).otherwise(F.raise_error(F.lit(f"no element at {place}"))), 1)
        return Val(found["v"], rel.elem.type)

    # ------------------------------------------------------------ expressions
    def ev(self, node: A.Node, env: dict, scope: Scope):
        return getattr(self, "ev_" + type(node).__name__)(node, env, scope)

    def col(self, node: A.Node, env: dict, scope: Scope) -> Val:
        v = self.ev(node, env, scope)
        return self.nest(v, scope) if isinstance(v, Rel) else v

    def ev_SelectQuery(self, node, env, scope):
        return self.select(node, env, scope)

    def ev_Literal(self, node: A.Literal, env, scope) -> Val:
        v = node.value
        if node.tag == "dt":
            if re.fullmatch(r"\d{4}-\d\d-\d\d", v):
                return Val(F.lit(v).cast("date"), T.DateType())
            zoned = re.search(r"(Z|[+-]\d\d:?\d\d)$", v)
            return Val(F.lit(v).cast("timestamp" if zoned else "timestamp_ntz"), T.TimestampType() if zoned else T.TimestampNTZType())
        if node.tag == "du":
            return Val(times.duration(v), T.DayTimeIntervalType())
        if node.tag == "b":
            return Val(F.lit(v.encode()), T.BinaryType())
        if node.tag:
            return Val(F.lit(v), T.StringType(), literal=v)
        kind = T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) and abs(v) >= 1 << 31 else T.IntegerType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
        return Val(F.lit(v), kind, literal=v)

    def ev_Name(self, node: A.Name, env, scope):
        if node.name in env:
            return env[node.name]
        if node.name in self.user:
            return self.user[node.name]
        if node.name == "None":
            return Val(F.lit(None))
        raise QueryError(f"unknown name {node.name}")

    def ev_Unary(self, node, env, scope):
        v = self.col(node.arg, env, scope)
        if node.op == "-":
            return Val(-v.col, v.type, literal=None if v.literal is None else -v.literal)
        return Val(~v.col, T.BooleanType())

    def ev_Binary(self, node: A.Binary, env, scope):
        if node.op in ("in", "not in"):
            return self.membership(node, env, scope)
        a, b = self.col(node.left, env, scope), self.col(node.right, env, scope)
        op, x, y = node.op, a.col, b.col
        yes = T.BooleanType()
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return Val({"==": x.__eq__, "!=": x.__ne__, "<": x.__lt__, "<=": x.__le__, ">": x.__gt__, ">=": x.__ge__}[op](y), yes)
        if op == "&&":
            return Val(x & y, yes)
        if op == "||":
            return Val(x | y, yes)
        if op in ("~~", "~~*", "=~"):
            return Val({"~~": lambda: F.like(x, y), "~~*": lambda: F.ilike(x, y), "=~": lambda: F.rlike(x, y)}[op](), yes)
        if op in ("&", "|", "^"):
            return Val({"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y), a.type)
        if op in ("<<", ">>"):
            return Val(F.call_function("shiftleft" if op == "<<" else "shiftright", x, y), a.type)
        ta, tb = self.type(a, scope), self.type(b, scope)
        whole = isinstance(ta, INTEGERS) and isinstance(tb, INTEGERS)
        wide = _wider(ta, tb)
        if op == "/":
            return self.divide(x, y, whole, wide)
        if op == "**":
            return Val(F.pow(x, y).cast(wide) if whole else F.pow(x, y), wide if whole else T.DoubleType())
        if op == "+" and isinstance(ta, T.StringType) and isinstance(tb, T.StringType):
            return Val(F.concat(x, y), ta)
        return Val({"+": x.__add__, "-": x.__sub__, "*": x.__mul__, "%": x.__mod__}[op](y), wide)

    @staticmethod
    def divide(x: Column, y: Column, whole: bool, wide) -> Val:
        """Integers divide to integers, toward zero; by zero is a runtime error."""
        if not whole:
            return Val(x / y, wide if isinstance(wide, T.DecimalType) else T.DoubleType())
        x, y = x.cast("long"), y.cast("long")
        # exact for all longs: the remainder goes first, and the quotient is whole
        return Val(F.call_function("div", x, y), T.LongType())

    def type(self, v: Val, scope: Scope):
        if v.type is None:
            try:
                return scope.type_of(v)
            except Exception:  # noqa: BLE001  a lambda's variable has no rows to be analysed over
                return None
        return v.type

    def membership(self, node: A.Binary, env, scope) -> Val:
        x = self.col(node.left, env, scope)
        right = node.right
        if isinstance(right, A.ListOf):
            hit = x.col.isin(*(self.col(i, env, scope).col for i in right.items)) if right.items else F.lit(False)
        elif isinstance(right, A.RangeOf):
            a, b = self.bounds(right, env, scope)
            hit = F.lit(True)
            hit = hit & (x.col >= a.col) if a else hit
            hit = hit & (x.col < b.col) if b else hit
        else:
            other = self.ev(right, env, scope)
            if isinstance(other, Rel):
                key = fresh("i")
                other = self.unfused(self.plain(other))
                rel = other.but(df=other.df.withColumn(key, other.elem.col), pk=(*other.pk, key), outer=(*other.outer, x.col))
                hit = scope.matches(rel)
            else:
                hit = F.array_contains(other.col, x.col)
        return Val(~hit if node.op == "not in" else hit, T.BooleanType())

    def ev_RangeOf(self, node, env, scope):
        a, b = (None if e is None else self.col(e, env, scope) for e in (node.start, node.end))
        none = F.lit(None)
        return Val(times.span(a.col if a else none, b.col if b else none, node.inclusive))

    def ev_Template(self, node, env, scope):
        return Val(F.concat(*(F.lit(p) if isinstance(p, str) else self.col(p, env, scope).col.cast("string") for p in node.parts)), T.StringType())

    def ev_ListOf(self, node, env, scope):
        items = [self.col(i, env, scope) for i in node.items]
        return Val(F.array(*(i.col for i in items)), T.ArrayType(items[0].type) if items and items[0].type else None, literal=[i.literal for i in items])

    def ev_Repeat(self, node, env, scope):
        v, n = self.col(node.item, env, scope), self.col(node.times, env, scope)
        return Val(F.array_repeat(v.col, n.col.cast("int")), T.ArrayType(v.type) if v.type else None)

    def ev_TupleOf(self, node, env, scope):
        items = [self.col(i, env, scope) for i in node.items]
        return Val(F.struct(*(i.col.alias(f"_{k + 1}") for k, i in enumerate(items))), T.StructType([T.StructField(f"_{k + 1}", i.type or T.NullType()) for k, i in enumerate(items)]) if all(i.type for i in items) else None)

    def ev_ObjectOf(self, node: A.ObjectOf, env, scope):
        return self.record(node.fields, env, scope)

    def record(self, fields, env, scope, own: Val | None = None) -> Val:
        out: dict[str, Val] = {}
        for name, e in fields:
            if name is None:
                v = self.col(e, env, scope)
                kind = self.type(v, scope)
                if not isinstance(kind, T.StructType):
                    raise QueryError("only objects can be spread")
                for f in kind.fields:
                    out[f.name] = Val(v.col[f.name], f.dataType)
            elif e is None:
                v = self.member(own, name, env, scope)
                out[name] = self.nest(v, scope) if isinstance(v, Rel) else v
            else:
                out[name] = self.col(e, env, scope)
        kinds = [self.type(v, scope) for v in out.values()]
        kind = T.StructType([T.StructField(n, k) for n, k in zip(out, kinds, strict=True)]) if all(kinds) else None
        return Val(F.struct(*(v.col.alias(n) for n, v in out.items())), kind)

    def ev_Comprehension(self, node: A.Comprehension, env, scope):
        (pattern, source), rest = node.loops[0], node.loops[1:]
        xs = self.col(source, env, scope)
        kind = self._element(xs, scope)
        inner = A.Comprehension(node.body, rest, node.condition) if rest else None

        def one(x: Column) -> Column:
            e = self.bind(pattern, Val(x, kind), env, scope)
            return self.ev(inner, e, scope).col if inner else self.col(node.body, e, scope).col

        arr = xs.col
        if node.condition is not None and not rest:
            arr = F.filter(arr, lambda x: F.coalesce(self.col(node.condition, self.bind(pattern, Val(x, kind), env, scope), scope).col, F.lit(False)))
        out = F.transform(arr, one)
        return Val(F.flatten(out) if rest else out)

    def ev_Lambda(self, node, env, scope):
        return Fn(node.params, node.body, env)

    def ev_If(self, node, env, scope):
        c, a = self.col(node.condition, env, scope), self.col(node.then, env, scope)
        if node.other is None:
            return Val(F.when(c.col, a.col), a.type)
        b = self.col(node.other, env, scope)
        return Val(F.when(c.col, a.col).otherwise(b.col), a.type or b.type)

    def ev_Match(self, node: A.Match, env, scope):
        s = self.col(node.subject, env, scope)
        out, kind = None, None
        for alts, guard, value in node.arms:
            test, inner = F.lit(False), env
            for alt in alts:
                if alt is None:
                    test = F.lit(True)
                elif isinstance(alt, A.RangeOf):
                    a, b = self.bounds(alt, env, scope)
                    test = test | ((s.col >= a.col) & (s.col < b.col))
                elif isinstance(alt, A.Name) and alt.name not in env and alt.name != "None":
                    test, inner = F.lit(True), {**env, alt.name: s}
                else:
                    test = test | (s.col == self.col(alt, env, scope).col)
            if guard is not None:
                test = test & self.col(guard, inner, scope).col
            v = self.col(value, inner, scope)
            kind = kind or v.type
            out = F.when(test, v.col) if out is None else out.when(test, v.col)
        return Val(out, kind)

    def ev_Block(self, node, env, scope):
        for pattern, e in node.lets:
            env = self.bind(pattern, self.ev(e, env, scope), env, scope)
        return self.ev(node.result, env, scope)

    def bind(self, pattern, value, env: dict, scope: Scope) -> dict:
        if isinstance(pattern, str):
            return {**env, pattern: value}
        return {**env, **{name: self.member(value, f, env, scope) for f, name in pattern}}

    def ev_BindAt(self, node, env, scope):
        v = self.ev(node.base, env, scope)
        if isinstance(v, Rel) and v.following is not None:
            return v.but(walked_as=node.name)
        if isinstance(v, Rel):
            return v.but(names=(node.name,), env={**v.env, node.name: v.elem})
        return Val(v.col, v.type, v.links, v.literal, (node.name,)) if not hasattr(v, "key") else _copy(v, binders=(node.name,))

    def ev_Cast(self, node, env, scope):
        v = self.col(node.base, env, scope)
        kind = CASTS.get(node.type)
        if kind is None:
            raise QueryError(f"can't cast to {node.type}")
        return Val(v.col.cast(kind), T._parse_datatype_string(kind))

    def ev_IsType(self, node, env, scope):
        v = self.col(node.base, env, scope)
        if node.type in CASTS:
            return Val(F.typeof(v.col) == CASTS[node.type], T.BooleanType())
        return Val(v.col["_type"] == node.type, T.BooleanType())

    # members and projections
    def member(self, v, name: str, env, scope):
        if isinstance(v, Rel):
            if not v.iterating:
                raise QueryError(f".{name} needs one element; use [*] to map over many")
            link = v.elem.links.get(name)
            if link is not None:
                return v.but(following=link, walked_as=None)
            return self.mapped(v, lambda e, s: self.member(v.elem, name, e, s), env)
        members = getattr(v, "members", None)
        if members and name in members:
            return members[name]()
        fields = getattr(v, "key_fields", None)
        if fields and name in fields:
            return fields[name]
        if name in v.links:
            link = v.links[name]
            rows = link.make()
            return rows.but(outer=(link.key,))
        kind = v.type
        if isinstance(kind, T.ArrayType) and not v.binders:
            raise QueryError(f".{name} needs one element; use [*] to map over many")
        if isinstance(kind, T.StructType):
            if name not in kind.names:
                raise QueryError(f"no field {name}; there are {', '.join(kind.names)}")
            return Val(v.col[name], kind[name].dataType)
        return Val(v.col[name])

    def ev_Member(self, node, env, scope):
        base = self.ev(node.base, env, scope)
        if isinstance(base, Rel) and base.following is not None:
            base = self.stars(base, 1)
        if isinstance(base, Val) and getattr(base, "many", False):
            return self.over(base, lambda x: self.member(x, node.name, env, scope), scope)
        return self.member(base, node.name, env, scope)

    def ev_Project(self, node, env, scope):
        base = self.ev(node.base, env, scope)
        if isinstance(base, Rel):
            if not base.iterating and base.following is None:
                raise QueryError("a projection needs one element; use [*] to map over many")
            if base.following is not None:
                base = self.stars(base, 1)
            return self.mapped(base, lambda e, s: self.record(node.fields, e, s, base.elem), env)
        if getattr(base, "many", False):
            return self.over(base, lambda x: self.record(node.fields, {**env, **dict.fromkeys(base.binders, x)}, scope, x), scope)
        return self.record(node.fields, env, scope, base)

    def over(self, arr: Val, fn, scope: Scope) -> Val:
        kind = self._element(arr, scope)
        got: dict = {}

        def one(x: Column) -> Column:
            v = fn(Val(x, kind))
            got["type"] = v.type
            return v.col

        out = Val(F.transform(arr.col, one), None, binders=arr.binders)
        out.type = T.ArrayType(got["type"]) if got.get("type") else None
        out.many = True
        return out

    def _element(self, arr: Val, scope: Scope):
        kind = self.type(arr, scope)
        return kind.elementType if isinstance(kind, T.ArrayType) else None

    def stars(self, rel: Rel, n: int) -> Rel:
        link = rel.following
        if link is not None:
            return self.follow(rel, link)
        return self._kept(rel, rel.but(iterating=True))

    def ev_Select_(self, node: A.Select_, env, scope):
        base = self.ev(node.base, env, scope)
        if isinstance(base, Fn):
            raise QueryError("a function has no elements")
        return self.select_rel(node, base, env, scope) if isinstance(base, Rel) else self.select_array(node, base, env, scope)

    def select_rel(self, node: A.Select_, rel: Rel, env, scope):
        kind = node.kind
        if kind == "stars":
            out = self.stars(rel, node.arg)
            link_depth = 2 if rel.following is not None else 1
            for _ in range(node.arg - link_depth):
                out = self.exploded(out)
            return out
        if rel.following is not None:
            rel = self.stars(rel, 1)
        if kind == "where":
            return self.where(rel, node.arg, env, scope)
        if kind == "order":
            return self.ordered(rel, node.arg, env)
        if kind == "slice":
            return self.sliced(rel, node.arg, env, scope)
        if kind == "index":
            v = self.col(node.arg, env, scope)
            if v.literal is None:
                raise QueryError("an index over rows must be a constant")
            return self.picked(rel, v.literal, scope, True)
        if kind == "group":
            return self.grouped(rel, node.arg, env)
        if kind == "distinct":
            return self.distinct(rel)
        if kind == "distinct_by":
            row = Scope(self.plain(rel).df)
            key = self.col(node.arg, self.in_rows(rel, env), row)
            return self.distinct_by(rel.but(df=row.df), key.col)
        if kind == "enumerate":
            return self.enumerated(rel)
        raise QueryError(kind)

    def exploded(self, rel: Rel) -> Rel:
        """Rows of an array element."""
        rel = self.unfused(self.plain(rel))
        kind = self.type(rel.elem, Scope(rel.df))
        name = fresh("e")
        df = rel.df.withColumn(name, F.explode(rel.elem.col))
        return rel.but(df=df, elem=Val(F.col(name), kind.elementType), iterating=True)

    def distinct(self, rel: Rel) -> Rel:
        rel = self.unfused(self.plain(rel))
        name = fresh("d")
        df = rel.df.select(*rel.pk, rel.elem.col.alias(name)).distinct()
        return Rel(df, Val(F.col(name), rel.elem.type), {}, rel.pk, rel.outer, (), rel.names, True)

    def distinct_by(self, rel: Rel, key: Column) -> Rel:
        rel = self.unfused(self.plain(rel))
        n, k = fresh("n"), fresh("k")
        df = rel.df.withColumn(k, key)
        w = Window.partitionBy(*rel.pk, k).orderBy(*sorting(rel.order))
        return rel.but(df=df.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n, k), iterating=True)

    def enumerated(self, rel: Rel) -> Rel:
        rel = self.unfused(self.plain(rel))
        n = fresh("n")
        kind = T.StructType([T.StructField("index", T.LongType()), T.StructField("value", rel.elem.type or T.NullType())]) if rel.elem.type else None
        if not rel.pk:
            v = fresh("v")
            keys = [(fresh("o"), c, down) for c, down in rel.order]
            df = rel.df.select(rel.elem.col.alias(v), *(c.alias(k) for k, c, _ in keys))
            df = numbered(df, sorting(tuple((F.col(k), down) for k, _, down in keys)) if keys else [], n)
            elem = Val(F.struct(F.col(n).alias("index"), F.col(v).alias("value")), kind)
            return Rel(df, elem, order=((F.col(n), False),) if keys else (), names=rel.names, iterating=True)
        w = Window.partitionBy(*rel.pk).orderBy(*sorting(rel.order))
        df = rel.df.withColumn(n, F.row_number().over(w).cast("long") - 1)
        return rel.but(df=df, elem=Val(F.struct(F.col(n).alias("index"), rel.elem.col.alias("value")), kind), iterating=True)

    def select_array(self, node: A.Select_, arr: Val, env, scope):
        kind = node.kind
        element = self._element(arr, scope)

        def inner(x: Column) -> dict:
            return {**env, **{n: Val(x, element) for n in arr.binders}}

        def keep(col: Column, type_=..., many=True) -> Val:
            out = Val(col, arr.type if type_ is ... else type_, binders=arr.binders)
            out.many = many
            return out

        if kind == "stars":
            col, t = arr.col, self.type(arr, scope)
            for _ in range(node.arg - 1):
                col = C.flattened(col)
                t = t.elementType if isinstance(t, T.ArrayType) else None
            return keep(col, t)
        if kind == "where":
            return keep(C.where(arr.col, lambda x: self.col(node.arg, inner(x), scope).col))
        if kind == "order":
            return keep(C.ordered(arr.col, [(lambda x, k=k: self.col(k.expr, inner(x), scope).col, k.descending) for k in node.arg]))
        if kind == "slice":
            a, b = (None if e is None else self.col(e, env, scope).col for e in (node.arg.start, node.arg.end))
            return keep(C.sliced(arr.col, a, b, node.arg.inclusive))
        if kind == "index":
            return Val(C.at(arr.col, self.col(node.arg, env, scope).col), element)
        if kind == "distinct":
            return keep(F.array_distinct(arr.col))
        if kind == "distinct_by":
            return keep(C.distinct_by(arr.col, lambda x: self.col(node.arg, inner(x), scope).col))
        if kind == "enumerate":
            return keep(C.enumerated(arr.col), T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("value", element)])) if element else None)
        if kind == "group":
            keys = lambda x: self.record(node.arg.fields, inner(x), scope).col
            groups = F.transform(F.array_distinct(F.transform(arr.col, keys)), lambda k: F.struct(k.alias("key"), F.filter(arr.col, lambda x: keys(x) == k).alias("items")))
            return keep(groups, None)
        raise QueryError(kind)

    # calls
    def apply(self, fn, args: list, scope: Scope):
        """A closure or a named function on values."""
        if not isinstance(fn, Fn):
            raise QueryError("a function is needed")
        env = dict(fn.env)
        for p, a in zip(fn.params, args, strict=False):
            env = self.bind(p, a, env, scope)
        v = self.ev(fn.body, env, scope)
        return self.nest(v, scope) if isinstance(v, Rel) else v

    def ev_Call(self, node: A.Call, env, scope):
        if not isinstance(node.fn, A.Name):
            raise QueryError("only names can be called")
        name = node.fn.name
        target = env.get(name, self.user.get(name))
        if isinstance(target, Fn):
            return self.apply(target, [self.ev(a, env, scope) for a in node.args], scope)
        short = name.split("::")[-1]
        if short == "transitive_closure" and node.args and isinstance(node.args[0], A.ObjectOf) and "step" in dict(node.args[0].fields):
            config = dict(node.args[0].fields)
            return self.closure_by(self.ev(config["seed"], env, scope), self.ev(config["step"], env, scope), self.ev(config["key"], env, scope))
        if node.args and (name.split("::")[0] in ("graph", "tree", "search") or name in ("geo::within_radius", "geo::nearest")):
            return self.table_function(name, node, env, scope)
        if name in FUNCTIONS and (name.startswith("geo::") or not (short in self.METHODS_OF_MANY and node.args and self._many(node.args[0], env, scope))):
            return self.builtin(FUNCTIONS[name], list(node.args), env, scope)
        if name in ("Some", "Ok"):
            return self.ev(node.args[0], env, scope)
        if name == "is" and len(node.args) == 2:
            return self.ev_IsType(A.IsType(node.args[0], node.args[1].name), env, scope)
        if node.args:
            return self.ev_Method(A.Method(node.args[0], {"array::count": "len", "math::count": "count", "math::mean": "avg", "unique_by": "distinct_by", "stats::mean": "avg", "array::len": "len"}.get(name, short), node.args[1:]), env, scope)
        raise QueryError(f"unknown function {name}")

    def _many(self, node, env, scope) -> bool:
        v = self.ev(node, env, scope)
        return isinstance(v, Rel) or isinstance(self.type(v, scope), T.ArrayType)

    def builtin(self, f: Function, args: list, env, scope) -> Val:
        built, first = [], None
        for i, a in enumerate(args):
            if i in f.raw:
                v = a.value if isinstance(a, A.Literal) else a.name.split("::")[-1] if isinstance(a, A.Name) else self.ev(a, env, scope).literal
                built.append(v)
            else:
                v = a if isinstance(a, Val) else self.col(a, env, scope)
                first = first or v
                built.append(v.col)
        kind = first.type if f.returns == "same" and first else _RETURNS.get(f.returns or "")
        return Val(f.build(*built), kind)

    def table_function(self, name: str, node: A.Call, env, scope):
        rel = self.ev(node.args[0], env, scope)
        if not isinstance(rel, Rel):
            raise QueryError(f"{name} needs a collection")
        config: dict[str, Any] = {}
        for a in node.args[1:]:
            if isinstance(a, A.ObjectOf):
                config |= {k: self.ev(v, env, scope).literal for k, v in a.fields}
            else:
                config.setdefault("at", self.ev(a, env, scope).literal)
        df = self.plain(rel)
        df = df.df.select(df.elem.col.alias("v")).select("v.*")
        out = tables.call(name, df, config)
        col = fresh("t")
        out = out.select(F.struct(*out.columns).alias(col))
        return Rel(out, Val(F.col(col), out.schema[col].dataType), iterating=True)

    METHODS_OF_MANY = frozenset(
        "len count is_empty any all none sum min max avg mean variance stddev median quantile approx_quantile approx_count_distinct histogram correlation covariance linear_regression moving_average rank "
        "map filter filter_map flat_map flatten compact order_by order_by_asc order_by_desc reversed enumerate map_indexed rank_by group_by index_by key_by associate_by fold reduce scan contains contains_by "
        "partition distinct distinct_by union intersect except union_all intersect_all except_all join_by left_join_by semi_join_by anti_join_by zip slice range skip take at get first last exactly_one "
        "expect_one top_k items key to_array transitive_closure binary_search_by partition_point".split()
    )

    def ev_Method(self, node: A.Method, env, scope):
        base = self.ev(node.base, env, scope)
        if isinstance(base, Rel):
            return self.rel_method(node, base, env, scope)
        if node.name == "key" and hasattr(base, "key_fields"):
            return Val(base.col, base.type)
        if node.name in ("items",) and hasattr(base, "members"):
            return base.members["items"]()
        kind = self.type(base, scope)
        if isinstance(kind, T.ArrayType) or (kind is None and node.name in self.METHODS_OF_MANY and node.name not in METHODS) or getattr(base, "many", False):
            got = self.array_method(node, base, env, scope)
            if got is not None:
                return got
        if isinstance(kind, T.MapType):
            got = self.map_method(node, base, env, scope)
            if got is not None:
                return got
        if isinstance(kind, T.StringType) and node.name in ("len", "contains"):
            return Val(F.length(base.col), T.IntegerType()) if node.name == "len" else Val(F.contains(base.col, self.col(node.args[0], env, scope).col), T.BooleanType())
        if isinstance(kind, T.StructType) and {"start", "end", "inclusive"} <= set(kind.names):
            other = [self.col(a, env, scope).col for a in node.args]
            ops = {"contains": times.span_contains, "overlaps": times.span_overlaps, "intersect": times.span_intersect, "union": times.span_union, "is_empty": times.span_is_empty}
            if node.name in ops:
                return Val(ops[node.name](base.col, *other))
        if isinstance(kind, T.StructType):
            names = set(kind.names)
            if node.name == "round" and names == {"amount", "currency"}:
                return self.builtin(FUNCTIONS["money::round"], [base, *node.args], env, scope)
            if node.name in ("intersects", "overlaps", "touches", "contains") and {"west", "south", "east", "north"} <= names:
                return self.builtin(FUNCTIONS["geo::box_contains" if node.name == "contains" else f"geo::{node.name}"], [base, *node.args], env, scope)
        if node.name in METHODS:
            return self.builtin(METHODS[node.name], [base, *node.args], env, scope)
        if node.name in self.METHODS_OF_MANY:
            got = self.array_method(node, base, env, scope)
            if got is not None:
                return got
        raise QueryError(f"unknown method {node.name}")

    # -- methods of rows
    def rel_method(self, node: A.Method, rel: Rel, env, scope):
        name, args = node.name, node.args
        if name == "items" and rel.group_scope is not None:
            members = self.unfused(rel.group_scope.members())
            return members.but(iterating=True)
        if rel.following is not None:
            rel = self.stars(rel, 1)
        fn = lambda i=0: self.ev(args[i], env, scope)
        if name in ("len", "count", "is_empty", "sum", "min", "max", "avg", "mean", "variance", "stddev", "median", "approx_count_distinct"):
            if args:
                rel = self._map(rel, fn(), env)
            return self.aggregate(rel, name, scope)
        if name in ("quantile", "approx_quantile", "correlation", "covariance", "linear_regression"):
            return self.aggregate(rel, name, scope, tuple(fn(i) for i in range(len(args))))
        if name in ("any", "all", "none"):
            if rel.group is not None:
                p = self.apply(fn(), [rel.elem], Scope(rel.df)).col if args else F.lit(True)
                hit = F.coalesce(p, F.lit(False))
                test = ~hit if name == "all" else hit
                test = test if rel.cond is None else rel.cond & test
                (c,) = scope.reduce(rel, [F.count_if(test)])
                found = F.coalesce(c, F.lit(0)) > 0
            else:
                found = scope.matches(self.tested(self.plain(rel), node, env))
            return Val(found if name == "any" else ~found, T.BooleanType())
        if name in ("map", "flat_map", "filter_map"):
            out = self._map(rel, fn(), env)
            if name == "flat_map":
                return self.exploded(out)
            return self._compacted(out) if name == "filter_map" else out
        if name == "filter":
            return self._filter(rel, fn(), env)
        if name == "compact":
            return self._compacted(rel)
        if name == "flatten":
            return self.exploded(rel)
        if name in ("order_by", "order_by_asc", "order_by_desc", "top_k"):
            f = fn(1 if name == "top_k" else 0)
            row = Scope(self.plain(rel).df) if rel.group_scope is None else rel.group_scope
            keys = self._order_keys(f, rel, row, name in ("order_by_desc", "top_k"))
            out = self._kept(rel, self.unfused(rel).but(order=tuple(keys), iterating=True))
            if name == "top_k":
                return self.sliced(out, A.RangeOf(None, args[0], False), env, scope)
            return out
        if name == "reversed":
            if not rel.order and rel.pk:
                raise QueryError("reversed needs an order")
            rel = rel if rel.order else self.placed(self.unfused(self.plain(rel)))[0]
            return self._kept(rel, rel.but(order=tuple((c, not down) for c, down in rel.order)))
        if name in ("slice", "range") and isinstance(args[0], A.RangeOf):
            return self.sliced(rel, args[0], env, scope)
        if name == "skip":
            return self.sliced(rel, A.RangeOf(args[0], None, False), env, scope)
        if name == "take":
            return self.sliced(rel, A.RangeOf(None, args[0], False), env, scope)
        if name in ("at", "get", "first", "last"):
            n = {"first": 0, "last": -1}.get(name)
            return self.picked(rel, fn().literal if n is None else n, scope, name == "at")
        if name in ("distinct",):
            return self.distinct(rel)
        if name == "distinct_by":
            row = Scope(self.plain(rel).df)
            return self.distinct_by(rel.but(df=row.df), self.apply(fn(), [rel.elem], row).col)
        if name == "enumerate":
            return self.enumerated(rel)
        if name == "map_indexed":
            e = self.enumerated(rel)
            return self._map2(e, fn(), [Val(e.elem.col["value"], rel.elem.type), Val(e.elem.col["index"], T.LongType())])
        if name in ("rank_by", "rank"):
            return self.ranked(rel, fn() if args else None, env)
        if name == "moving_average":
            return self.moving(rel, fn().literal)
        if name == "histogram":
            return self.histogram(rel, fn().literal, scope)
        if name in ("union", "intersect", "except", "union_all", "intersect_all", "except_all"):
            return self.set_op(rel, fn(), name)
        if name in ("join_by", "left_join_by", "semi_join_by", "anti_join_by"):
            return self.join_by(rel, fn(), self.ev(args[1], env, scope), name)
        if name == "zip":
            return self.zipped(rel, fn())
        if name in ("group_by", "index_by"):
            out = self._grouped_by(rel, fn(), env)
            return self._map_groups(out) if name == "index_by" else out
        if name in ("key_by", "associate_by"):
            return self.keyed(rel, fn(), self.ev(args[1], env, scope) if name == "associate_by" else None)
        if name == "partition":
            return _Halves({"matched": lambda: self._filter(rel, fn(), env, True), "rest": lambda: self._filter(rel, fn(), env, False)}, lambda r: self.nest(r, scope).col)
        if name == "contains":
            v = self.col(args[0], env, scope)
            return Val(scope.matches(self._where_col(self.plain(rel), rel.elem.col == v.col)), T.BooleanType())
        if name == "contains_by":
            return self.rel_method(A.Method(node.base, "any", args), rel, env, scope)
        if name in ("exactly_one", "expect_one"):
            # two rows tell one from many
            arr = self.nest(self.sliced(self.plain(rel), A.RangeOf(None, A.Literal(2), False), env, scope), scope)
            return Val(C.exactly_one(arr.col)) if name == "exactly_one" else Val(C.expect_one(arr.col), rel.elem.type)
        if name == "to_array":
            return rel
        if name == "items":
            return rel
        if name == "transitive_closure":
            return self.closure(node, rel, env, scope)
        if name == "search" and args and isinstance(args[0], A.Call) and args[0].fn.name.endswith("_query"):
            kind = args[0].fn.name.split("::")[-1].removesuffix("_query")
            return self.table_function(f"search::{kind}", A.Call(A.Name(f"search::{kind}"), (node.base, *args[0].args)), env, scope)
        # what is sequential by nature runs over the ordered array
        arr = self.nest(rel, scope)
        got = self.array_method(node, arr, env, scope)
        if got is None:
            raise QueryError(f"unknown method {name}")
        return got

    def _map(self, rel: Rel, f: Fn, env) -> Rel:
        return self.mapped(rel, lambda e, s: self.apply(f, [rel.elem], s), env)

    def _map2(self, rel: Rel, f: Fn, args: list) -> Rel:
        row = Scope(rel.df)
        v = self.apply(f, args, row)
        return rel.but(df=row.df, elem=v, iterating=True)

    def _where_col(self, rel: Rel, cond: Column) -> Rel:
        return rel.but(df=rel.df.where(cond)) if rel.group is None else rel.but(cond=cond if rel.cond is None else rel.cond & cond)

    def _filter(self, rel: Rel, f: Fn, env, keep: bool = True) -> Rel:
        gs = rel.group_scope
        row = gs or Scope(rel.df)
        p = F.coalesce(self.apply(f, [rel.elem], row).col, F.lit(False))
        p = p if keep else ~p
        if gs:
            gs.steps.append(lambda df: df.where(p))
            return self._kept(rel, rel.but(iterating=True))
        return self._where_col(rel if rel.group is not None else rel.but(df=row.df), p).but(iterating=True)

    def _compacted(self, rel: Rel) -> Rel:
        return self._where_col(self.plain(rel), rel.elem.col.isNotNull())

    def _order_keys(self, f: Fn, rel: Rel, row: Scope, down: bool) -> list[tuple[Column, bool]]:
        """Keys of a closure: one, a tuple, order::desc(k) or desc(k)."""
        env = dict(f.env)
        for p in f.params:
            env = self.bind(p, rel.elem, env, row)
        body = f.body.items if isinstance(f.body, A.TupleOf) else (f.body,)
        out = []
        for b in body:
            d = down
            if isinstance(b, A.Call) and isinstance(b.fn, A.Name) and b.fn.name.split("::")[-1] in ("asc", "desc"):
                d, b = b.fn.name.endswith("desc"), b.args[0]
            c = self.col(b, env, row).col
            out.append((c, d))
        return out

    def ranked(self, rel: Rel, f: Fn | None, env) -> Rel:
        rel = self.unfused(self.plain(rel))
        row = Scope(rel.df)
        keys = self._order_keys(f, rel, row, False) if f else [(rel.elem.col, False)]
        i, r, d = fresh("n"), fresh("r"), fresh("d")
        places = [T.StructField(n, T.LongType()) for n in ("index", "rank", "dense_rank")]
        kind = T.StructType([T.StructField("value", rel.elem.type), *places]) if rel.elem.type else None

        def element(value: Column) -> Val:
            return Val(F.struct(value.alias("value"), F.col(i).alias("index"), F.col(r).alias("rank"), F.col(d).alias("dense_rank")), kind)

        if not rel.pk:
            v, ks = fresh("v"), [fresh("k") for _ in keys]
            own = [(F.col(k), down) for k, (_, down) in zip(ks, keys, strict=True)]
            ties = [fresh("o") for _ in rel.order]
            df = row.df.select(rel.elem.col.alias(v), *(c.alias(k) for k, (c, _) in zip(ks, keys, strict=True)), *(c.alias(t) for t, (c, _) in zip(ties, rel.order, strict=True)))
            df = numbered(df, sorting((*own, *((F.col(t), down) for t, (_, down) in zip(ties, rel.order, strict=True)))), i)
            return Rel(ranks(df, own, ks, i, r, d), element(F.col(v)), order=((F.col(i), False),), names=rel.names, iterating=True)
        part = Window.partitionBy(*rel.pk)
        by = part.orderBy(*sorting(keys))
        df = row.df.withColumns({i: F.row_number().over(part.orderBy(*sorting((*keys, *rel.order)))).cast("long") - 1, r: F.rank().over(by).cast("long"), d: F.dense_rank().over(by).cast("long")})
        return rel.but(df=df, elem=element(rel.elem.col), iterating=True, order=((F.col(i), False),))

    #: Positions of a block of a moving window.
    BLOCK = 1 << 16

    def moving(self, rel: Rel, width: int) -> Rel:
        """Means of the last ``width`` elements.  A whole collection is cut into
        blocks of positions, each with the last elements of the one before."""
        rel = self.unfused(self.plain(rel))
        m = fresh("m")
        if rel.pk:
            w = Window.partitionBy(*rel.pk).orderBy(*sorting(rel.order)).rowsBetween(1 - width, 0)
            return rel.but(df=rel.df.withColumn(m, F.avg(rel.elem.col).over(w)), elem=Val(F.col(m), T.DoubleType()), iterating=True)
        rel, n = self.placed(rel)
        size, block, own = max(width, self.BLOCK), fresh("b"), fresh("w")
        at = F.floor(F.col(n) / size)
        blocks = F.when(F.col(n) % size > size - width, F.array(at, at + 1)).otherwise(F.array(at))
        df = rel.df.withColumn(own, at).withColumn(block, F.explode(blocks))
        w = Window.partitionBy(block).orderBy(n).rowsBetween(1 - width, 0)
        df = df.withColumn(m, F.avg(rel.elem.col).over(w)).where(F.col(block) == F.col(own))
        return rel.but(df=df, elem=Val(F.col(m), T.DoubleType()))

    def histogram(self, rel: Rel, n: int, scope: Scope) -> Rel:
        """Equal-width cells: {cell (0-based), count}; equal values are all in the first."""
        rel = self.unfused(self.plain(rel))
        lo, hi = rel.df.agg(F.min(rel.elem.col)).scalar(), rel.df.agg(F.max(rel.elem.col)).scalar()
        cell, k = fresh("c"), fresh("k")
        width = (hi - lo) / F.lit(n)
        df = rel.df.select(F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((rel.elem.col - lo) / F.nullif(width, F.lit(0.0))), F.lit(n - 1))).cast("int").alias(cell)).groupBy(cell).agg(F.count("*").alias(k))
        return Rel(df, Val(F.struct(F.col(cell).alias("cell"), F.col(k).alias("count")), T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("count", T.LongType())])), iterating=True)

    def _column(self, rel: Rel, name: str) -> DataFrame:
        rel = self.unfused(self.plain(rel))
        return rel.df.select(*rel.pk, rel.elem.col.alias(name))

    def set_op(self, a: Rel, b: Rel, name: str) -> Rel:
        col = fresh("s")
        x, y = self._column(a, col), self._column(b, col)
        if x.columns != y.columns:
            y = y.toDF(*x.columns)
        df = {
            "union": lambda: x.union(y).distinct(), "intersect": lambda: x.intersect(y), "except": lambda: x.subtract(y),
            "union_all": lambda: x.unionAll(y), "intersect_all": lambda: x.intersectAll(y), "except_all": lambda: x.exceptAll(y),
        }[name]()
        return Rel(df, Val(F.col(col), a.elem.type), {}, a.pk, a.outer, iterating=True, names=a.names)

    def join_by(self, a: Rel, b: Rel, f: Fn, name: str) -> Rel:
        a, b = self.unfused(self.plain(a)), self.unfused(self.plain(b))
        x, y = fresh("x"), fresh("y")
        left, right = a.df.select(*a.pk, a.elem.col.alias(x)), b.df.select(b.elem.col.alias(y))
        on = self.apply(f, [Val(F.col(x), a.elem.type), Val(F.col(y), b.elem.type)], self.unit())
        how = {"join_by": "inner", "left_join_by": "left", "semi_join_by": "left_semi", "anti_join_by": "left_anti"}[name]
        df = left.join(right, on.col, how)
        if how in ("left_semi", "left_anti"):
            return Rel(df, Val(F.col(x), a.elem.type), {}, a.pk, a.outer, iterating=True)
        kind = T.StructType([T.StructField("left", a.elem.type), T.StructField("right", b.elem.type)]) if a.elem.type and b.elem.type else None
        return Rel(df, Val(F.struct(F.col(x).alias("left"), F.col(y).alias("right")), kind), {}, a.pk, a.outer, iterating=True)

    def zipped(self, a: Rel, b: Rel) -> Rel:
        x, y = self.enumerated(a), self.enumerated(b)
        l, r = fresh("x"), fresh("y")
        left, right = x.df.select(x.elem.col.alias(l)), y.df.select(y.elem.col.alias(r))
        df = left.join(right, F.col(l)["index"] == F.col(r)["index"])
        kind = T.StructType([T.StructField("left", a.elem.type), T.StructField("right", b.elem.type)]) if a.elem.type and b.elem.type else None
        return Rel(df, Val(F.struct(F.col(l)["value"].alias("left"), F.col(r)["value"].alias("right")), kind), iterating=True)

    def _grouped_by(self, rel: Rel, f: Fn, env) -> Rel:
        param = f.params[0]
        body = f.body
        fields = body.fields if isinstance(body, A.ObjectOf) else (("key", body),)
        names = (param,) if isinstance(param, str) else ()
        out = self.grouped(rel.but(names=names) if names else rel, A.ObjectOf(fields), f.env)
        return out.but(iterating=True) if out.group_scope is None else self._kept(out, out.but(iterating=True))

    def _map_groups(self, groups: Rel) -> Rel:
        """A lookup: key and array of values for each key."""
        gs = groups.group_scope
        members = gs.members()
        arr = self.nest(members, gs)
        fields = groups.elem.key_fields
        key = next(iter(fields.values())) if len(fields) == 1 else Val(groups.elem.col, groups.elem.type)
        kind = T.StructType([T.StructField("key", key.type), T.StructField("values", arr.type)]) if key.type and arr.type else None
        return self._kept(groups, groups.but(elem=Val(F.struct(key.col.alias("key"), arr.col.alias("values")), kind), iterating=True))

    def keyed(self, rel: Rel, key: Fn, value: Fn | None) -> Rel:
        """One row for each key; a repeated key is a runtime error."""
        rel = self.unfused(self.plain(rel))
        row = Scope(rel.df)
        k = self.apply(key, [rel.elem], row)
        v = self.apply(value, [rel.elem], row) if value else rel.elem
        a, b = fresh("k"), fresh("v")
        df = row.df.select(*rel.pk, k.col.alias(a), v.col.alias(b)).groupBy(*rel.pk, a).agg(F.first(b).alias(b), F.count("*").alias("n"))
        once = F.when(F.col("n") == 1, F.col(b)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(a).cast("string"))))
        return Rel(df, Val(F.struct(F.col(a).alias("key"), once.alias("value"))), {}, rel.pk, rel.outer, iterating=True)

    def closure(self, node: A.Method, rel: Rel, env, scope) -> Rel:
        """transitive_closure({seed, ...}) of edges with _from and _to."""
        fields = {k: v for k, v in node.args[0].fields} if node.args and isinstance(node.args[0], A.ObjectOf) else {}
        seed = self.ev(fields["seed"], env, scope).literal if "seed" in fields else None
        rel = self.unfused(self.plain(rel))
        edges = rel.df.select(rel.elem.col["_from"].alias("_from"), rel.elem.col["_to"].alias("_to"))
        out = tables.call("graph::transitive_closure", edges, {"seed": seed})
        col = fresh("t")
        out = out.select(F.struct(*out.columns).alias(col))
        return Rel(out, Val(F.col(col), out.schema[col].dataType), iterating=True)

    def closure_by(self, seed: Rel, step: Fn, key: Fn) -> Rel:
        """Elements reached from ``seed`` by any number of steps, each key once.

        The elements must be of one type, whose links the step walks.  A round
        joins the frontier with the step and removes known keys, so cycles
        end; each frontier is written to the shared folder once."""
        start = seed.elem
        if not hasattr(start, "id"):
            raise QueryError("the seed must be documents with an id")
        col, known = fresh("c"), fresh("k")

        def elements(df: DataFrame) -> Rel:
            v = _copy(Val(F.col(col), start.type), key=F.col(col)[start.id], id=start.id, rows=start.rows)
            v.links = {n: Link(link.label, v.key, link.make) for n, link in start.links.items()}
            return Rel(df, v, iterating=True)

        def keyed(rel: Rel) -> DataFrame:
            rel = self.stars(rel, 1) if rel.following is not None else rel
            rel = self.unfused(self.plain(rel))
            row = Scope(rel.df)
            k = self.apply(key, [rel.elem], row).col
            return row.df.select(rel.elem.col.alias(col), k.alias(known)).dropDuplicates([known])

        front = seen = cut(keyed(seed))
        while not front.isEmpty():
            env = self.bind(step.params[0], elements(front), dict(step.env), self.unit())
            reached = keyed(self.ev(step.body, env, self.unit()))
            front = cut(reached.join(seen.select(known), known, "left_anti").select(col, known))
            seen = seen.unionAll(front)
        return elements(seen)

    # -- methods of arrays and maps
    def array_method(self, node: A.Method, arr: Val, env, scope) -> Val | None:
        name, x, args = node.name, arr.col, node.args
        element = self._element(arr, scope)
        same = arr.type
        ev = lambda i=0: self.ev(args[i], env, scope)
        c = lambda i=0: self.col(args[i], env, scope).col

        def call(f, *types):
            return lambda *cols: self.apply(f, [Val(v, t) for v, t in zip(cols, types, strict=False)], scope).col

        def one(i=0):
            g = call(ev(i), element)
            return lambda v: g(v)

        def result(f, *cols_types) -> T.DataType | None:
            try:
                return self.apply(f, [Val(F.lit(None).cast(t) if t else F.lit(None), t) for t in cols_types], scope).type
            except Exception:  # noqa: BLE001  the type is only a help
                return None

        many = lambda v, t=same: _many(Val(v, t))
        if name in ("len", "count"):
            return Val(F.size(x), T.IntegerType())
        if name == "is_empty":
            return Val(F.size(x) == 0, T.BooleanType())
        if name == "any":
            return Val(C.exists(x, one()) if args else F.size(x) > 0, T.BooleanType())
        if name == "all":
            return Val(C.every(x, one()), T.BooleanType())
        if name == "none":
            return Val(~C.exists(x, one()) if args else F.size(x) == 0, T.BooleanType())
        if name == "sum":
            return Val(C.total(x, F.lit(0).cast(element) if element else F.lit(0.0)), element)
        if name == "min":
            return Val(F.array_min(x), element)
        if name == "max":
            return Val(F.array_max(x), element)
        if name in ("avg", "mean"):
            return Val(C.average(x), T.DoubleType())
        if name in ("variance", "stddev", "median", "quantile", "moving_average", "histogram"):
            clean = F.array_compact(x)
            if name in ("variance", "stddev"):
                return Val(getattr(C, name)(clean), T.DoubleType())
            if name in ("median", "quantile"):
                return Val(C.quantile(clean, F.lit(0.5) if name == "median" else c()), T.DoubleType())
            if name == "moving_average":
                return many(C.moving_average(x, c()), T.ArrayType(T.DoubleType()))
            return many(C.histogram(clean, c()), T.ArrayType(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("count", T.LongType())])))
        if name == "map":
            t = result(ev(), element)
            return many(F.transform(x, one()), T.ArrayType(t) if t else None)
        if name == "filter":
            return many(C.where(x, one()))
        if name == "filter_map":
            t = result(ev(), element)
            return many(F.array_compact(F.transform(x, one())), T.ArrayType(t) if t else None)
        if name == "flat_map":
            return many(C.flattened(F.transform(x, one())), result(ev(), element))
        if name == "flatten":
            return many(C.flattened(x), element)
        if name == "compact":
            return many(F.array_compact(x))
        if name in ("order_by", "order_by_asc", "order_by_desc"):
            f = ev()
            body = f.body.items if isinstance(f.body, A.TupleOf) else (f.body,)
            keys = []
            for b in body:
                d = name == "order_by_desc"
                if isinstance(b, A.Call) and isinstance(b.fn, A.Name) and b.fn.name.split("::")[-1] in ("asc", "desc"):
                    d, b = b.fn.name.endswith("desc"), b.args[0]
                keys.append((call(Fn(f.params, b, f.env), element), d))
            return many(C.ordered(x, keys))
        if name == "reversed":
            return many(F.reverse(x))
        if name == "enumerate":
            return many(C.enumerated(x), T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("value", element)])) if element else None)
        if name == "map_indexed":
            f = ev()
            t = result(f, element, T.IntegerType())
            return many(F.transform(x, lambda v, i: call(f, element, T.IntegerType())(v, i)), T.ArrayType(t) if t else None)
        if name == "rank_by":
            return many(C.ranked(x, one()), None)
        if name == "fold":
            init, f = self.col(args[0], env, scope), ev(1)
            t = init.type if not isinstance(init.type, T.IntegerType) or not isinstance(element, (T.LongType, T.DoubleType)) else element
            start = init.col.cast(t) if t else init.col
            return Val(F.aggregate(x, start, lambda a, v: call(f, t, element)(a, v).cast(t) if t else call(f, t, element)(a, v)), t)
        if name == "reduce":
            f = ev()
            return Val(C.reduced(x, lambda a, v: call(f, element, element)(a, v)), element)
        if name == "scan":
            init, f = self.col(args[0], env, scope), ev(1)
            t = element if isinstance(init.type, T.IntegerType) and isinstance(element, (T.LongType, T.DoubleType)) else init.type
            kind = result(f, t, element)
            right = kind["right"].dataType if isinstance(kind, T.StructType) else t

            def step(a, v):
                pair = call(f, t, element)(a, v)
                return F.struct(pair["left"].cast(t).alias("left"), pair["right"].alias("right"))

            return many(C.scanned(x, init.col.cast(t), step, right.simpleString()), T.ArrayType(right))
        if name == "contains":
            return Val(F.array_contains(x, c()), T.BooleanType())
        if name == "contains_by":
            return Val(C.exists(x, one()), T.BooleanType())
        if name == "partition":
            return Val(C.partitioned(x, one()), T.StructType([T.StructField("matched", same), T.StructField("rest", same)]) if same else None)
        if name == "distinct":
            return many(F.array_distinct(x))
        if name == "distinct_by":
            return many(C.distinct_by(x, one()))
        if name in ("union", "intersect", "except"):
            return many({"union": F.array_union, "intersect": F.array_intersect, "except": F.array_except}[name](x, c()))
        if name == "zip":
            return many(C.zipped(x, c()), None)
        if name in ("slice", "range") and isinstance(args[0], A.RangeOf):
            r = args[0]
            a, b = (None if e is None else self.col(e, env, scope).col for e in (r.start, r.end))
            return many(C.sliced(x, a, b, r.inclusive))
        if name == "skip":
            return many(C.sliced(x, c(), None))
        if name == "take":
            return many(C.sliced(x, None, c()))
        if name == "at":
            return Val(C.at(x, c()), element)
        if name == "get":
            return Val(C.get(x, c()), element)
        if name == "first":
            return Val(C.first(x), element)
        if name == "last":
            return Val(C.last(x), element)
        if name == "exactly_one":
            return Val(C.exactly_one(x))
        if name == "expect_one":
            return Val(C.expect_one(x), element)
        if name == "top_k":
            return many(C.top_k(x, c(), one(1) if len(args) > 1 else None))
        if name == "index_by":
            return Val(C.index_by(x, one()), None)
        if name == "key_by":
            return Val(C.key_by(x, one()), None)
        if name == "associate_by":
            return Val(C.associate_by(x, one(), one(1)), None)
        if name == "group_by":
            key = one()
            return many(F.transform(F.array_distinct(F.transform(x, key)), lambda k: F.struct(k.alias("key"), F.filter(x, lambda v: key(v) == k).alias("items"))), None)
        if name == "binary_search_by":
            return Val(C.binary_search_by(x, one(), c(1)), T.IntegerType())
        if name == "partition_point":
            return Val(C.partition_point(x, one()), T.IntegerType())
        return None

    def map_method(self, node: A.Method, m: Val, env, scope) -> Val | None:
        name, x, kind = node.name, m.col, self.type(m, scope)
        k, v = kind.keyType, kind.valueType
        c = lambda i=0: self.col(node.args[i], env, scope).col
        f = lambda i=0: self.ev(node.args[i], env, scope)
        if name == "len":
            return Val(F.size(x), T.IntegerType())
        if name == "is_empty":
            return Val(F.size(x) == 0, T.BooleanType())
        if name == "get":
            return Val(F.try_element_at(x, c()), v)
        if name == "with":
            return Val(C.map_with(x, c(), c(1)), kind)
        if name == "without":
            return Val(C.map_without(x, c()), kind)
        if name in ("lower_bound", "upper_bound"):
            return Val(C.map_bound(x, c(), name == "upper_bound"), T.StructType([T.StructField("key", k), T.StructField("value", v)]))
        if name == "range" and isinstance(node.args[0], A.RangeOf):
            a, b = self.bounds(node.args[0], env, scope)
            return Val(C.map_range(x, a.col if a else None, b.col if b else None), T.ArrayType(T.StructType([T.StructField("key", k), T.StructField("value", v)])))
        if name == "map_values":
            fn = f()
            return Val(F.transform_values(x, lambda _, y: self.apply(fn, [Val(y, v)], scope).col))
        if name == "filter_entries":
            fn = f()
            return Val(F.map_filter(x, lambda a, b: self.apply(fn, [Val(a, k), Val(b, v)], scope).col), kind)
        if name == "merge":
            fn = f(1)
            return Val(C.map_merge(x, c(), lambda a, b: self.apply(fn, [Val(a, v), Val(b, v)], scope).col), kind)
        return None


class _Halves(Val):
    """Both parts of a partition: rows by name, arrays only if the whole is asked for."""

    def __init__(self, members: dict, nested) -> None:
        super().__init__(None)
        self.members, self.nested = members, nested

    @property
    def col(self) -> Column:
        return F.struct(*(self.nested(make()).alias(n) for n, make in self.members.items()))

    @col.setter
    def col(self, _) -> None:
        pass


class _Pending:
    """An element that rows will give later; its links wait for it."""

    def __init__(self) -> None:
        self.links: dict[str, Any] = {}


def _merged(a: Link, b: Link) -> Link:
    """One label from two paths: the union of both traversals' rows."""

    def rows() -> Rel:
        x, y = a.make(), b.make()
        names = [fresh("p"), fresh("v")]
        p, q = (r.df.select(F.col(r.pk[0]).alias(names[0]), r.elem.col.alias(names[1])) for r in (x, y))
        return Rel(p.union(q).distinct(), Val(F.col(names[1]), x.elem.type), pk=(names[0],), names=x.names)

    return Link(a.label, a.key, rows)


def _copy(v: Val, **changes) -> Val:
    out = Val(v.col, v.type, v.links, v.literal, v.binders)
    out.__dict__.update({**v.__dict__, **changes})
    return out


def _many(v: Val) -> Val:
    v.many = True
    return v


def _conjuncts(node: A.Node) -> list[A.Node]:
    if isinstance(node, A.Binary) and node.op == "&&":
        return _conjuncts(node.left) + _conjuncts(node.right)
    return [node]


def _names(node) -> list[A.Name]:
    """All names in a tree."""
    if isinstance(node, A.Name):
        return [node]
    out: list[A.Name] = []
    parts = node if isinstance(node, (tuple, list)) else vars(node).values() if isinstance(node, A.Node) else ()
    for p in parts:
        if isinstance(p, (A.Node, tuple, list)):
            out += _names(p)
    return out


def _wider(a, b):
    if a is None or b is None:
        return a or b
    ranks = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.FloatType, T.DoubleType]
    if type(a) in ranks and type(b) in ranks:
        if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
            return None
        return a if ranks.index(type(a)) >= ranks.index(type(b)) else b
    return a if not isinstance(b, (T.DateType, T.TimestampType, T.TimestampNTZType)) else b
