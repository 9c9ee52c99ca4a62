"""Rounding shared by both sides of a query, so the last bits of a floating sum do not matter."""

from pyspark.sql import Column, functions as F


def rnd(c, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def rnds(*names: str, n: int = 6) -> list[Column]:
    return [rnd(c, n).alias(c) for c in names]


def r(expr: str, name: str | None = None, n: int = 6) -> str:
    return f"round({expr}, {n})+0e0" + (f" as {name}" if name else "")


def rs(*names: str, n: int = 6) -> str:
    return ", ".join(r(c, c, n) for c in names)
