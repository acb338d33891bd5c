"""Upkeep of tables: migrations run once each, and what must hear of a change."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import keyed

LOG = logging.getLogger(__name__)


def applied(spark: SparkSession, log: str) -> set[str]:
    """Names of the migrations that ran; there are as many as someone has written."""
    return {r["name"] for r in keyed.read(spark, log).select("name").collect()} if keyed.exists(spark, log) else set()


def migrate(spark: SparkSession, migrations: Iterable[tuple[str, str]], log: str, now: str) -> list[str]:
    """Runs (name, SQL text) in the order of their names, each once; returns the names that ran.

    A text is a script of statements, run by Spark as one block. A failing one stops the rest; it is not logged, so the next call begins with it:
    statements should be such that they can be run again (IF NOT EXISTS).
    """
    done, ran = applied(spark, log), []
    for name, text in sorted(migrations):
        if name in done:
            continue
        spark.sql(f"BEGIN\n{text.strip().rstrip(';')};\nEND")
        line = spark.createDataFrame([(name,)], "name string").withColumn("applied_at", F.lit(now).cast("timestamp"))
        keyed.merge(line, log) if keyed.exists(spark, log) else keyed.create(line, log, ["name"], 1)
        ran.append(name)
    return ran


def changed(spark: SparkSession, tag: str, paths: Iterable[str] = (), tables: Iterable[str] = (), tell: Callable[[str], None] | None = None) -> bool:
    """After a write: what Spark has cached of the paths and tables is read anew, and tell(tag) reaches whoever else holds a copy.

    Without tell nobody else does. A failing tell is logged, not raised: the data are stored.
    """
    for path in paths:
        spark.catalog.refreshByPath(path)
    for table in tables:
        spark.catalog.refreshTable(table)
    if tell is None:
        return False
    try:
        tell(tag)
    except Exception as e:
        LOG.warning("%s: nobody was told of the change (%s)", tag, e)
        return False
    return True
