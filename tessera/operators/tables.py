"""Table functions by their names in the language: graph::*, tree::*, search::*, geo::within_radius and geo::nearest."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from tessera.language.lexer import QueryError
from tessera.operators import graph, search


def call(name: str, df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Apply a table function to rows with a config object or one plain argument."""
    space, short = name.split("::", 1)
    at = config.get("at")
    if space == "graph":
        simple = {"neighbors": graph.neighbors, "out_edges": graph.out_edges, "in_edges": graph.in_edges}
        if short in simple:
            return simple[short](df, at)
        if short == "traverse":
            return graph.traverse(df, config["from"], config.get("lo", 1), config.get("hi", 1))
        if short == "transitive_closure":
            return graph.transitive_closure(df, config.get("seed"))
        if short == "shortest_path":
            return graph.shortest_path(df, config["source"], config.get("target"), config.get("weight"))
        if short == "pagerank":
            return graph.pagerank(df, config.get("damping", 0.85), config.get("iterations", 10))
        whole = {"connected_components": graph.connected_components, "strongly_connected_components": graph.strongly_connected_components, "topological_sort": graph.topological_sort}
        if short in whole:
            return whole[short](df)
    if space == "tree":
        one = {n: getattr(graph, n) for n in ("children", "parent", "ancestors", "descendants", "depth", "path_to_root", "preorder", "postorder", "level_order")}
        if short in one:
            return one[short](df, at if at is not None else config.get("root"))
        if short == "lowest_common_ancestor":
            return graph.lowest_common_ancestor(df, config["a"], config["b"])
    if space == "search":
        column, key = config.get("column", "text"), config.get("id", df.columns[0])
        if short == "text":
            return search.all_terms(df, column, config.get("text") or at)
        if short == "full_text":
            return search.full_text(df, key, column, config["text"], config.get("limit", 10))
        if short == "phrase":
            return search.phrase(df, key, column, config["phrase"], config.get("slop", 0), config.get("limit"))
        if short == "prefix":
            return search.prefix(df, column, config.get("prefix") or at)
        if short == "regex":
            return search.regex(df, column, config.get("pattern") or at)
        if short == "vector":
            return search.nearest_vectors(df, key, config.get("column", "embedding"), config["embedding"], config.get("k", 10))
        if short == "hybrid":
            texts = search.full_text(df, key, column, config["text"], config.get("limit", 100))
            near = search.nearest_vectors(df, key, config.get("vector", "embedding"), config["embedding"], config.get("limit", 100))
            return search.hybrid(texts, near, config.get("k", 10))
    if space == "geo":
        lon, lat, point = config.get("lon", "lon"), config.get("lat", "lat"), (config["x"], config["y"])
        if short == "within_radius":
            return search.within_radius(df, lon, lat, point, config["radius"])
        if short == "nearest":
            return search.nearest(df, lon, lat, point, config.get("k", 10))
    raise QueryError(f"unknown function {name}")
