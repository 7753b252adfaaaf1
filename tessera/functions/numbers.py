"""Numbers, decimals and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign(x: Column) -> Column:
    return F.signum(x)


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(x, hi))


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def rounded(x: Column, digits: int = 0, mode: str = "HalfUp") -> Column:
    """Rounds to ``digits`` places by one of HalfUp, HalfEven, Floor, Ceil, Down, Up."""
    scale = F.lit(10**digits)
    if mode == "HalfEven":
        return F.bround(x, digits)
    if mode == "HalfUp":
        return F.round(x, digits)
    if mode == "Floor":
        return F.floor(x * scale) / scale
    if mode == "Ceil":
        return F.ceil(x * scale) / scale
    if mode == "Down":
        return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale
    if mode == "Up":
        return F.when(x < 0, F.floor(x * scale)).otherwise(F.ceil(x * scale)) / scale
    raise ValueError(f"unknown rounding mode {mode}")


def decimal(unscaled: Column, scale: int) -> Column:
    return (unscaled.cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(38,0)")).cast(f"decimal(38,{scale})")


def decimal_parse(text: Column, scale: int = 10) -> Column:
    return text.cast(f"decimal(38,{scale})")


def money(amount: Column, currency: Column) -> Column:
    return F.struct(amount.alias("amount"), currency.alias("currency"))


def money_round(price: Column, digits: int, mode: str = "HalfEven") -> Column:
    return money(rounded(price["amount"], digits, mode), price["currency"])


def money_add(a: Column, b: Column) -> Column:
    """The sum; different currencies are a runtime error."""
    total = F.when(a["currency"] == b["currency"], a["amount"] + b["amount"]).otherwise(F.raise_error(F.concat(F.lit("currency mismatch: "), a["currency"], F.lit(" and "), b["currency"])).cast("double"))
    return money(total, a["currency"])


def exchange_rate(source: Column, target: Column, rate: Column) -> Column:
    return F.struct(source.alias("from"), target.alias("to"), rate.alias("rate"))


def money_convert(price: Column, rate: Column, digits: int = 2, mode: str = "HalfEven") -> Column:
    amount = F.when(price["currency"] == rate["from"], price["amount"] * rate["rate"]).otherwise(F.raise_error(F.lit("the rate is for another currency")).cast("double"))
    return money(rounded(amount, digits, mode), rate["to"])
