"""Rules and enrichers of one's own, as Python functions of a row: what fails on one row fails there alone.

A failing rule counts as one that doesn't match, a failing enricher leaves the row as it was, and each failure is a row of an
error table: event_id, hook, error. Batches are Arrow's; a worker that dies is repeated by Spark. Rules and enrichers that
Spark's own functions can express are better written as columns (see columns.first_match and Registry.enrich).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .lineage import checkpointed

Rule = Callable[[dict], str | None]
Enricher = Callable[[dict], dict | None]
_ERRORS = "__errors array<struct<hook:string,error:string>>"


def _mapped(df: DataFrame, schema: StructType, change: Callable[[dict], list[tuple[str, str]]]) -> DataFrame:
    """Each row as a dict through a function that changes it in place and tells of failures."""
    full = StructType([*schema.fields, *StructType.fromDDL(_ERRORS).fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                row["__errors"] = [{"hook": n, "error": e} for n, e in change(row)]
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return df.mapInArrow(run, full)


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:300]


def _split(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = checkpointed(mapped)  # the functions run once, though both parts are read
    errors = held.select("event_id", F.explode("__errors").alias("e")).select("event_id", "e.*")
    return held.drop("__errors"), errors


def classified_by(df: DataFrame, rules: dict[str, Rule]) -> tuple[DataFrame, DataFrame]:
    """Fill category, and matched_rule, of rows without one by the first rule, in order, that gives a text; and the failures."""
    known = [f for f in df.schema.fields if f.name not in ("category", "matched_rule")]
    schema = StructType([*known, *StructType.fromDDL("category string, matched_rule string").fields])

    def change(row: dict) -> list[tuple[str, str]]:
        failed = []
        row["matched_rule"] = None
        row.setdefault("category", None)
        for name, rule in rules.items():
            if row["category"] is not None:
                break
            try:
                found = rule(dict(row))
                if found is not None:
                    row["category"], row["matched_rule"] = str(found), name
            except Exception as e:
                failed.append((name, _said(e)))
        return failed

    return _split(_mapped(df, schema, change))


def enriched_by(df: DataFrame, enrichers: dict[str, Enricher], adds: str = "") -> tuple[DataFrame, DataFrame]:
    """Each enricher in turn gives the columns that it changes, of the table's and of those that `adds` (DDL) names; and the failures.

    A value of the wrong type is a failure of its enricher, too.
    """
    new = StructType.fromDDL(adds).fields if adds else []
    schema = StructType([*(f for f in df.schema.fields if f.name not in {n.name for n in new}), *new])
    kinds = {f.name: f.type for f in to_arrow_schema(schema)}

    def change(row: dict) -> list[tuple[str, str]]:
        failed = []
        for c in kinds:
            row.setdefault(c, None)
        for name, enrich in enrichers.items():
            try:
                more = enrich(dict(row)) or {}
                if unknown := set(more) - set(kinds):
                    raise KeyError(f"unknown columns {sorted(unknown)}")
                for c, v in more.items():
                    pa.array([v], kinds[c])
                row.update(more)
            except Exception as e:
                failed.append((name, _said(e)))
        return failed

    return _split(_mapped(df, schema, change))
