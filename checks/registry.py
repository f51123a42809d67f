"""Collects query callables and their DuckDB counterparts under one key."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from murmur.sources.views import DUCK_VIEWS, Tables
from murmur.streaming.folders import SETTING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Puts the definitions of the views that the text names in front of it."""
    defs = dict(DUCK_VIEWS)
    defs.update(extra or {})
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in defs.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({defs[name].strip()})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def ready(spark: SparkSession) -> SparkSession:
    """On one machine a session without a shared folder gets a temporary one; a cluster names its own."""
    if spark.sparkContext.master.startswith("local[") and not spark.conf.get(SETTING, None):
        spark.conf.set(SETTING, tempfile.mkdtemp(prefix="murmur-"))
    return spark


def check(key: str, sql: str | None = None, extra: dict[str, str] | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise KeyError(key)
        QUERIES[key] = lambda spark, folder: fn(Tables(ready(spark), folder))
        if sql is not None:
            ORACLES[key] = with_views(sql, extra)
        return fn
    return add
