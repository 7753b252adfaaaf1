"""Full-text, phrase, prefix, vector and hybrid search, and spatial lookups.

Exact by full scan: filters are pushed to the scan where they can be, scores
come from aggregates, and a top-k is a TakeOrdered of k rows for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo, text, vectors
from tessera.operators.shared import cut

#: Usual parameters of BM25, and of reciprocal rank fusion.
K1, B, RRF = 1.2, 0.75, 60


def all_terms(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose tokens hold every term of the query."""
    terms = [t for t in query.lower().split() if t]
    tokens = text.tokens(F.col(column))
    cond = F.lit(True)
    for t in terms:
        cond = cond & F.array_contains(tokens, t)
    return df.where(cond)


def full_text(df: DataFrame, id: str, column: str, query: str, limit: int = 10) -> DataFrame:
    """(id, score) of the best rows by BM25."""
    terms = sorted({t for t in query.lower().split() if t})
    if not terms:
        return df.select(F.col(id).alias("id"), F.lit(0.0).alias("score")).limit(0)
    # texts are read and tokenised once: what is kept of each is its length and a count for each term
    counted = lambda t: F.struct(F.size(t).alias("n"), F.array(*(F.size(F.array_remove(t, w)) for w in terms)).alias("rest"))
    docs = cut(df.select(F.col(id).alias("id"), text.bound(text.tokens(F.col(column)), counted).alias("c")).select("id", "c.n", F.transform("c.rest", lambda r: F.col("c.n") - r).alias("tf")))
    whole = docs.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))))
    n, mean = whole.select("docs").scalar(), whole.select("mean").scalar()
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, seen = F.col("tf")[i], whole.select(f"df{i}").scalar()
        score = score + F.log(1 + (n - seen + 0.5) / (seen + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / mean))
    return docs.where(F.exists("tf", lambda x: x > 0)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def phrase(df: DataFrame, id: str, column: str, words: str, slop: int = 0, limit: int | None = None) -> DataFrame:
    """(id, position) of the phrase; with slop, words in order within so many extra tokens."""
    terms = words.lower().split()
    if not slop:
        out = df.select(F.col(id).alias("id"), F.explode(text.phrase_positions(F.col(column), terms)).alias("position"))
    else:
        at = df.select(F.col(id).alias("id"), F.posexplode(text.tokens(F.col(column))).alias("p", "t")).where(F.col("t").isin(*terms))
        out = at.where(F.col("t") == terms[0]).select("id", F.col("p").alias("position"), F.col("p").alias("last"))
        for t in terms[1:]:
            nxt = at.where(F.col("t") == t).select(F.col("id").alias("i"), F.col("p").alias("q"))
            out = out.join(nxt, (F.col("id") == F.col("i")) & (F.col("q") > F.col("last"))).groupBy("id", "position").agg(F.min("q").alias("last"))
        out = out.where(F.col("last") - F.col("position") <= len(terms) - 1 + slop).select("id", "position")
    return out.orderBy("id", "position").limit(limit) if limit else out


def prefix(df: DataFrame, column: str, p: str) -> DataFrame:
    return df.where(F.startswith(F.col(column), F.lit(p)))


def regex(df: DataFrame, column: str, p: str) -> DataFrame:
    return df.where(F.col(column).rlike(p))


def nearest_vectors(df: DataFrame, id: str, column: str, query: DataFrame | Column | list, k: int = 10) -> DataFrame:
    """(id, score) of the k rows of largest cosine similarity to a vector: a
    list, a Column, or the only column of a DataFrame's first row."""
    if isinstance(query, DataFrame):
        df, q = df.crossJoin(F.broadcast(query.toDF("__q").limit(1))), F.col("__q")
    else:
        q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    return df.select(F.col(id).alias("id"), vectors.cosine(F.col(column), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hybrid(texts: DataFrame, vectors_: DataFrame, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two scored lists (id, score); both are short."""
    from pyspark.sql import Window

    rank = lambda df: df.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select("id", (1 / (RRF + F.col("r"))).alias("s"))
    return rank(texts).unionAll(rank(vectors_)).groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def within_radius(df: DataFrame, lon: str, lat: str, at: tuple[float, float], metres: float) -> DataFrame:
    """Rows within a distance: a box that pushes down, then the exact distance."""
    import math

    x, y = at
    dy = math.degrees(metres / geo.EARTH)
    dx = dy / max(1e-9, math.cos(math.radians(min(89.9, abs(y) + dy))))
    box = F.col(lat).between(y - dy, y + dy) & (F.col(lon).between(x - dx, x + dx) | F.lit(dx >= 180))
    d = geo.haversine(geo.point(F.col(lon), F.col(lat)), geo.point(F.lit(x), F.lit(y)))
    return df.where(box).withColumn("distance", d).where(F.col("distance") <= metres)


def nearest(df: DataFrame, lon: str, lat: str, at: tuple[float, float], k: int = 10) -> DataFrame:
    d = geo.haversine(geo.point(F.col(lon), F.col(lat)), geo.point(F.lit(at[0]), F.lit(at[1])))
    return df.withColumn("distance", d).orderBy("distance").limit(k)
