"""Keyword rules, the user's own table: JSON lines of {"category", "sub_category", "keywords": [...]}, in order."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.classify import Rules

#: Bytes of rules that go to the driver at most: they become a constant of the plan.
MAX_BYTES = 1 << 20


def read_rules(spark: SparkSession, path: str) -> Rules:
    """The rules of one file, in the order of its lines; keywords in lower case. Lines without keywords count for nothing; a larger file than MAX_BYTES is refused."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > MAX_BYTES:
        raise ValueError(f"{path} has {size} bytes of keyword rules; {MAX_BYTES} at most become part of a plan")
    lines = files.orderBy("path").select(F.posexplode(F.split(F.decode("content", "utf-8"), "\n")).alias("at", "line"), "path")
    rule = F.from_json("line", "category string, sub_category string, keywords array<string>")
    rows = lines.select("path", "at", rule.alias("r")).filter("size(r.keywords) > 0 and r.category is not null").orderBy("path", "at").collect()
    return [(x["r"]["category"], x["r"]["sub_category"], tuple(k.lower() for k in x["r"]["keywords"] if k)) for x in rows]
