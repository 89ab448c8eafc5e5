"""Results as JSON text, byte by byte in the served form."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.scalars import escape_json

CALLBACK = r"[A-Za-z_$][A-Za-z0-9_$.]*"


def _joined(item: Column) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))  # at most 32 a request
    return F.array_join(F.transform(ordered, lambda x: x["item"]), ",\n")


def rich_item() -> Column:
    snippet = F.when(F.col("snippet") != "", F.concat(F.lit(', "snippet": "'), escape_json(F.col("snippet")), F.lit('"'))).otherwise(F.lit(""))
    return F.concat(F.lit(' { "phrase": "'), escape_json(F.col("phrase")), F.lit('", "score": '), F.col("score").cast("string"), snippet, F.lit(" }"))


def rich_json(results: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, json) of results (keys, rank, phrase, score, snippet). Rows without results are not there."""
    body = F.concat(F.lit("["), _joined(rich_item()), F.when(F.count("*") > 0, F.lit("\n")).otherwise(F.lit("")), F.lit("]"))
    return results.groupBy(*keys).agg(body.alias("json"))


def list_json(results: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, json): the query, keys[0], and the phrases."""
    item = F.concat(F.lit('"'), escape_json(F.col("phrase")), F.lit('"'))
    body = F.concat(F.lit('[ "'), escape_json(F.first(keys[0])), F.lit('", ['), _joined(item), F.when(F.count("*") > 0, F.lit("\n")).otherwise(F.lit("")), F.lit("] ]"))
    return results.groupBy(*keys).agg(body.alias("json"))


def jsonp(json: Column, callback: str | None) -> Column:
    """Wrap in a call; only names are allowed as callbacks, others are left out."""
    if callback and re.fullmatch(CALLBACK, callback):
        return F.concat(F.lit(f"{callback}("), json, F.lit(");\n"))
    return F.concat(json, F.lit("\n"))


def render_rows(q: str, rows: list[dict], kind: str | None, callback: str | None) -> str:
    """The same for the few rows of one request, on the driver."""
    esc = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
    end = "\n" if rows else ""
    if kind == "list":
        quoted = ",\n".join(f'"{esc(r["phrase"])}"' for r in rows)
        body = f'[ "{esc(q)}", [{quoted}{end}] ]'
    else:
        snippet = lambda r: f', "snippet": "{esc(r["snippet"])}"' if r["snippet"] else ""
        body = "[" + ",\n".join(f' {{ "phrase": "{esc(r["phrase"])}", "score": {r["score"]}{snippet(r)} }}' for r in rows) + end + "]"
    return f"{callback}({body});\n" if callback and re.fullmatch(CALLBACK, callback) else body + "\n"
