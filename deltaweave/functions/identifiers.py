"""Identifiers of 16 bytes, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ZERO = "0" * 32


def new() -> Column:
    return F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))


def sequential(df: DataFrame, name: str = "id") -> DataFrame:
    """Unique, increasing within a partition; no shuffle."""
    return df.withColumn(name, F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 32, "0")))


def parse(text: Column) -> Column:
    """Hex to bytes; empty text is the zero identifier; anything else that isn't 32 hex digits is null."""
    return F.when(text == "", F.unhex(F.lit(ZERO))).when(text.rlike("^[0-9a-fA-F]{32}$"), F.unhex(text))


def text(ident: Column) -> Column:
    return F.lower(F.hex(ident))


def short(ident: Column) -> Column:
    """The last four bytes."""
    return F.right(text(ident), F.lit(8))


def is_zero(ident: Column) -> Column:
    return ident == F.unhex(F.lit(ZERO))


def to_json(ident: Column) -> Column:
    return F.concat(F.lit('"'), text(ident), F.lit('"'))


def from_json(value: Column) -> Column:
    return parse(F.from_json(F.concat(F.lit('{"x":'), value, F.lit("}")), "x string")["x"])


def kind_name(kind: Column) -> Column:
    """Names of the numbers of change kinds."""
    return F.when(kind == 0, "added").when(kind == 1, "removed").when(kind == 2, "updated").otherwise("unknown")
