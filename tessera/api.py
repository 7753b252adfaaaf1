"""The engine: queries in, results out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.language import ast as A
from tessera.language.lexer import QueryError
from tessera.language.parser import parse
from tessera.operators import mutations
from tessera.plans.compiler import Compiler, _names
from tessera.plans.values import Fn, Rel, Scope, Val, fresh, sorting
from tessera.sources.catalog import Catalog, standard


def _names_of(node: A.Node | None) -> set[str]:
    return {n.name for n in _names(node)} if node is not None else set()


@dataclass
class Result:
    """A DataFrame and whether it stands for one value or for many."""

    df: DataFrame
    many: bool

    def value(self):
        """The one value of a ONE result."""
        row = self.df.first()
        return row[0] if len(row) == 1 else row


class Engine:
    """Runs queries over a catalog; mutations replace its snapshots."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.functions: dict[str, Fn] = {}

    @classmethod
    def standard(cls, spark: SparkSession, sf_dir: str) -> Engine:
        return cls(standard(spark, sf_dir))

    @property
    def spark(self) -> SparkSession:
        return self.catalog.spark

    def define(self, name: str, text: str) -> None:
        """A named function, as in define("double", "|x| x * 2"); it goes before a builtin."""
        node = parse(text)
        if not isinstance(node, A.Lambda):
            raise QueryError("a definition must be a function")
        self.functions[name] = Fn(node.params, node.body, {})

    def query(self, text: str, **values) -> Result:
        """Run one statement.  ``values`` are names it may use: DataFrames or constants."""
        node = parse(text)
        compiler = Compiler(self.catalog, self.functions)
        env = {k: self._value(v) for k, v in values.items()}
        scope = compiler.unit()
        if isinstance(node, A.Block) and not isinstance(node.result, A.SelectQuery):
            for pattern, e in node.lets:
                env = compiler.bind(pattern, compiler.ev(e, env, scope), env, scope)
            node = node.result
        run = {A.Create: self._create, A.Update: self._update, A.Delete: self._delete, A.LinkQuery: self._link, A.UnlinkQuery: self._unlink}.get(type(node))
        if run:
            return run(node, compiler, env)
        return self._result(compiler, compiler.query(node, env, scope), scope)

    def sql(self, text: str, **values) -> DataFrame:
        """The DataFrame of a query."""
        return self.query(text, **values).df

    def _value(self, v):
        if isinstance(v, DataFrame):
            col = fresh("v")
            df = v.select(F.struct(*v.columns).alias(col))
            return Rel(df, Val(F.col(col), df.schema[col].dataType))
        return Val(F.lit(v), literal=v)

    def _result(self, compiler: Compiler, v, scope: Scope) -> Result:
        if isinstance(v, Fn):
            raise QueryError("the result is a function")
        if isinstance(v, Rel):
            if v.following is not None:
                v = compiler.stars(v, 1)
            v = compiler.unfused(compiler.plain(v))
            # an order inside groups or parents is none of the whole result
            return Result(self._rows(v.df, v.elem, () if v.pk else v.order), True)
        return Result(self._rows(scope.df, v, ()), False)

    @staticmethod
    def _rows(df: DataFrame, v: Val, order: tuple) -> DataFrame:
        """One column for each field of an element; of other elements, ``value``.

        Elements are built and taken apart in one projection, so no struct is
        made at run time.
        """
        if order:
            df = df.orderBy(*sorting(order))
        out = df.select(v.col.alias("value"))
        kind = out.schema["value"].dataType
        return out.select("value.*") if isinstance(kind, T.StructType) else out

    # -- mutations
    def _new_rows(self, node: A.Create, compiler: Compiler, env: dict) -> DataFrame:
        objects = node.value.items if isinstance(node.value, A.ListOf) else (node.value,)
        frames = []
        for o in objects:
            scope = compiler.unit()
            v = compiler.col(o, env, scope)
            row = scope.df.select(v.col.alias("value")).select("value.*")
            frames.append(row.withColumn(mutations.GIVEN, F.array(*(F.lit(c) for c in row.columns))))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def _tail(self, node, compiler: Compiler, env: dict, default) -> Result:
        if getattr(node, "tail", None) is None:
            return default()
        compiler = Compiler(self.catalog, self.functions)
        scope = compiler.unit()
        return self._result(compiler, compiler.query(node.tail, env, scope), scope)

    def _count(self, n: int) -> Result:
        return Result(self.spark.createDataFrame([(n,)], "value long"), False)

    def _create(self, node: A.Create, compiler: Compiler, env: dict) -> Result:
        name = node.head.types[0]
        table = self.catalog[name]
        rows = self._new_rows(node, compiler, env)
        if node.upsert:
            keys, action = node.conflict or ((table.id,), "replace")
            self.catalog.replace(name, mutations.upserted(table.df, rows, keys, action))
        rows = rows.drop(mutations.GIVEN)
        if not node.upsert:
            self.catalog.replace(name, mutations.created(table.df, rows))
        full = mutations.conform(rows, table.df)
        if node.head.label:
            env = {**env, node.head.label: self._value(full)}
        for link in node.links:
            self._add_edges(link, Compiler(self.catalog, self.functions), env)
        return self._tail(node, compiler, env, lambda: Result(full, isinstance(node.value, A.ListOf)))

    def _update(self, node: A.Update, compiler: Compiler, env: dict) -> Result:
        name = node.head.types[0]
        table = self.catalog[name]
        rel = compiler.root(node.head, env, None)
        scope = Scope(rel.df)
        inner = compiler.in_rows(rel, env)
        where = compiler.col(node.where, inner, scope).col if node.where is not None else None
        col = next(c for c in rel.df.columns)
        names = table.df.columns
        setters, extra, hit = [], {}, fresh("hit")
        for path, op, e in node.setters:
            v = compiler.col(e, inner, scope)
            if path[0] not in names:
                raise QueryError(f"{name} has no field {path[0]}")
            old = F.col(col)
            for p in path:
                old = old[p]
            value = v.col if op == "=" else old + v.col if op == "+=" else old - v.col
            extra[key := fresh("s")] = value
            setters.append((path, F.col(key)))
        df = scope.df.withColumn(hit, F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)).withColumns(extra)
        flat = df.select(f"{col}.*", hit, *extra)
        n = flat.where(hit).count()
        self.catalog.replace(name, mutations.updated(flat, setters, F.col(hit)).select(*names))
        return self._tail(node, compiler, env, lambda: self._count(n))

    def _delete(self, node: A.Delete, compiler: Compiler, env: dict) -> Result:
        name = node.head.types[0]
        table = self.catalog[name]
        rel = compiler.root(node.head, env, None)
        if node.where is None:
            n = table.df.count()
            self.catalog.replace(name, table.df.limit(0))
            return self._tail(node, compiler, env, lambda: self._count(n))
        scope = Scope(rel.df)
        where = compiler.col(node.where, compiler.in_rows(rel, env), scope).col
        col, hit = rel.df.columns[0], fresh("hit")
        flat = scope.df.withColumn(hit, F.coalesce(where, F.lit(False))).select(f"{col}.*", hit)
        n = flat.where(hit).count()
        self.catalog.replace(name, flat.where(~F.col(hit)).select(*table.df.columns))
        return self._tail(node, compiler, env, lambda: self._count(n))

    def _ids(self, head: A.Head, compiler: Compiler, env: dict, name: str) -> tuple[Rel, DataFrame]:
        if head.types:
            rel, key = compiler.root(head, env, None), self.catalog[head.types[0]].id
        else:
            rel = env[head.label]
            rel = compiler.modified(rel.but(names=tuple(n for n in (head.binder, head.label) if n)), head.mods, env, None)
            fields = rel.elem.type.names
            key = next(t.id for t in self.catalog.opened() if t.id in fields and set(t.df.columns) == set(fields))
        return rel, rel.df.select(rel.elem.col[key].alias(name), rel.elem.col.alias(f"{name}_row"))

    def _add_edges(self, link: tuple, compiler: Compiler, env: dict) -> int:
        left, direction, edge, props, right = link
        if direction == "<-":
            left, right = right, left
        table = self.catalog[edge.types[0]]
        # what an end asks of the other one is the condition of the pairs
        asked = [_names_of(head.mods.where) & {n for n in (other.binder, other.label) if n} for head, other in ((left, right), (right, left))]
        conditions = [head.mods.where for head, both in zip((left, right), asked, strict=True) if both]
        left, right = (replace(head, mods=replace(head.mods, where=None)) if both else head for head, both in zip((left, right), asked, strict=True))
        a_rel, a = self._ids(left, compiler, env, "_from")
        b_rel, b = self._ids(right, compiler, env, "_to")
        # one edge for each matched pair, as the statement asks; with a condition it is a join
        pairs = a.crossJoin(b)
        scope = Scope(pairs)
        inner = dict(env)
        for head, rel, c in ((left, a_rel, "_from_row"), (right, b_rel, "_to_row")):
            for n in (head.binder, head.label):
                if n:
                    inner[n] = Val(F.col(c), rel.elem.type)
        for condition in conditions:
            scope.df = scope.df.where(compiler.col(condition, inner, scope).col)
        fields = {n: compiler.col(e, inner, scope).col for n, e in props.fields}
        rows = scope.df.select("_from", "_to", *(c.alias(n) for n, c in fields.items()))
        n = rows.count()
        self.catalog.replace(table.name, mutations.linked(table.df, table.source, table.target, rows))
        return n

    def _link(self, node: A.LinkQuery, compiler: Compiler, env: dict) -> Result:
        n = sum(self._add_edges(link, compiler, env) for link in node.links)
        return self._tail(node, compiler, env, lambda: self._count(n))

    def _unlink(self, node: A.UnlinkQuery, compiler: Compiler, env: dict) -> Result:
        n = 0
        for path in node.paths:
            if len(path.hops) != 1 or path.hops[0].hops is not None:
                raise QueryError("unlink takes one edge of one hop at a time")
            hop = path.hops[0]
            edge = hop.edge
            table = self.catalog[edge.types[0]]
            df, _, col = compiler.table(edge)
            e = F.col(col)
            rel = Rel(df, Val(e, df.schema[col].dataType), {edge.binder: Val(e, df.schema[col].dataType)} if edge.binder else {}, names=(edge.binder or edge.label or "edge",))
            if edge.mods.where is not None:
                rel = compiler.where(rel, edge.mods.where, env, None)
            near, far = ("_from", "_to") if hop.direction != "<-" else ("_to", "_from")
            for head, end in ((path.base, near), (hop.target, far)):
                if head is not None and (head.types or head.label in env):
                    _, ids = self._ids(head, compiler, env, "id")
                    key = fresh("k")
                    rel = rel.but(df=rel.df.join(ids.select(F.col("id").alias(key)).distinct(), rel.elem.col[end] == F.col(key), "left_semi"))
            matched = rel.df.select(rel.elem.col.alias("e")).select(*(F.col("e")[c].alias(c) for c in table.df.columns))
            rest = mutations.unlinked(table.df, matched)
            n += matched.count()
            self.catalog.replace(table.name, rest)
        return self._tail(node, compiler, env, lambda: self._count(n))
