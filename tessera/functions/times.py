"""Dates, durations and ranges of values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


def seconds_of(text: str) -> float:
    """Seconds of a duration such as 1h30m, 3w, or ISO-8601 PT1H30M."""
    iso = re.fullmatch(r"(-?)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if iso and len(text.strip("-P")):
        total = sum(float(n or 0) * k for n, k in zip(iso.groups()[1:], (604800, 86400, 3600, 60, 1), strict=True))
        return -total if iso[1] else total
    if not re.fullmatch(r"-?(?:\d+(?:ms|us|ns|[wdhms]))+", text):
        raise ValueError(f"not a duration: {text}")
    total = sum(int(n) * _UNITS[u] for n, u in re.findall(r"(\d+)(ms|us|ns|[wdhms])", text))
    return -total if text[0] == "-" else total


def duration(text: str) -> Column:
    return duration_seconds(F.lit(seconds_of(text)))


def duration_seconds(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)"))


def total_seconds(d: Column) -> Column:
    part = lambda u: F.extract(F.lit(u), d)
    return (part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")).cast("double")


def bucket(t: Column, width: str) -> Column:
    """The start of the window of the given width that holds ``t``."""
    return F.window(t, f"{int(seconds_of(width))} seconds")["start"]


def span(start: Column, end: Column, inclusive: bool = False) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.lit(inclusive).alias("inclusive"))


def span_contains(r: Column, v: Column) -> Column:
    return (v >= r["start"]) & ((v < r["end"]) | (r["inclusive"] & (v == r["end"])))


def span_overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def span_intersect(a: Column, b: Column) -> Column:
    return F.struct(F.greatest(a["start"], b["start"]).alias("start"), F.least(a["end"], b["end"]).alias("end"), (a["inclusive"] & b["inclusive"]).alias("inclusive"))


def span_union(a: Column, b: Column) -> Column:
    """The hull; disjoint ranges are a runtime error."""
    end = F.greatest(a["end"], b["end"])
    ok = (a["start"] <= b["end"]) & (b["start"] <= a["end"])
    return F.struct(F.least(a["start"], b["start"]).alias("start"), F.when(ok, end).otherwise(F.raise_error(F.lit("the ranges are disjoint")).cast("long")).alias("end"), (a["inclusive"] | b["inclusive"]).alias("inclusive"))


def span_is_empty(r: Column) -> Column:
    return (r["start"] > r["end"]) | ((r["start"] == r["end"]) & ~r["inclusive"])
