"""Typed projections of VARIANT values."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Field(NamedTuple):
    """One output column: its name, the key or dotted path inside the value, and its type."""

    name: str
    path: str
    type: str = "string"


def fields(type_name: str, *pairs: str | tuple[str, str]) -> list[Field]:
    """Fields of one type; a plain string keeps the source key as the column name."""
    return [Field(p, p, type_name) if isinstance(p, str) else Field(p[1], p[0], type_name) for p in pairs]


def pick(value: Column, path: str, type_name: str = "string") -> Column:
    """Value at a path, NULL where it is missing or does not convert."""
    if path == "$":
        return F.try_variant_get(value, path, type_name)
    return F.try_variant_get(value, f"${path}" if path.startswith("[") else f"$.{path}", type_name)


def typed(value: Column, spec: Iterable[Field]) -> list[Column]:
    return [pick(value, f.path, f.type).alias(f.name) for f in spec]
