"""Metadata filters ({"year": {"$gt": 2020}, "lang": "en"}) as predicates.

Keys and operators are joined by "and"; a missing key fits nothing, not even $ne; an empty filter fits all. An
operator that isn't known is an error."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda c, x: c == x,
    "$ne": lambda c, x: c != x,
    "$gt": lambda c, x: c > x,
    "$gte": lambda c, x: c >= x,
    "$lt": lambda c, x: c < x,
    "$lte": lambda c, x: c <= x,
}
#: a JSON field takes the type of what it is compared with; all numbers are doubles, so 2.5 is greater than 2
CASTS = {bool: "boolean", int: "double", float: "double", str: "string"}


def predicate(where: Mapping[str, Any], field: Callable[[str, type], Column]) -> Column:
    """field(name, type of the literal): the column of a key."""
    tests = []
    for key, spec in where.items():
        for op, x in (spec if isinstance(spec, Mapping) else {"$eq": spec}).items():
            if op not in OPERATORS:
                raise ValueError(f"unknown operator {op}")
            far = type(x) is int and abs(x) >= 2**63
            tests.append(F.coalesce(OPERATORS[op](field(key, type(x)), F.lit(float(x) if far else x)), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def on_columns(where: Mapping[str, Any]) -> Column:
    """For metadata in columns of their own: such predicates reach the scan."""
    return predicate(where, lambda name, _: F.col(name))


def json_field(json: str, name: str) -> Column:
    """A field by its exact name, whatever characters that has."""
    if "'" in name or "?" in name:  # paths can't name it
        return F.from_json(json, "map<string,string>")[name]
    return F.get_json_object(json, f"$['{name}']")


def on_json(where: Mapping[str, Any], json: str = "metadata") -> Column:
    """For metadata in a JSON column."""
    return predicate(where, lambda name, kind: json_field(json, name).try_cast(CASTS[kind]))


def ids_by_metadata(docs: DataFrame, where: Mapping[str, Any], json: str = "metadata") -> DataFrame:
    return docs.filter(on_json(where, json)).select("id")
