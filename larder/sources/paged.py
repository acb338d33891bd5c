"""Sources that come page by page: a store's offers until the first empty page, and details for ids in batches.

Fetching is the caller's function, called in tasks: a partition for each store, or for each batch of ids. Pages that
are a table already go through until_empty, which is joins and groupings only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages of a store that are read at most, and ids asked for at once.
MAX_PAGES, BATCH = 60, 50


def until_empty(pages: DataFrame, source: str, number: str, items: Column, max_pages: int = MAX_PAGES) -> DataFrame:
    """Pages (numbered from 1 within a source) that come before the source's first empty or missing page, max_pages at most. items: how many a page has."""
    rows = pages.filter(F.col(number).between(1, max_pages))
    key = rows.select(F.col(source).alias("__s"), F.col(number).alias("__n"), F.coalesce(items, F.lit(0)).alias("__items")).groupBy("__s", "__n").agg(F.max("__items").alias("__items"))
    before = key.select("__s", (F.col("__n") + 1).alias("__n"), F.lit(True).alias("__after"))
    ends = key.join(before, ["__s", "__n"], "left").filter((F.col("__items") == 0) | ((F.col("__n") > 1) & F.col("__after").isNull()))
    last = ends.groupBy("__s").agg(F.min("__n").alias("__end"))
    return rows.join(last, rows[source] == last["__s"], "left").filter(F.col("__end").isNull() | (F.col(number) < F.col("__end"))).drop("__s", "__end")


def wanted_details(ids: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Details, once a key, of the ids that are asked for; ids without details give nothing."""
    return details.join(ids.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_semi").dropDuplicates([key])


class _Part(InputPartition):
    def __init__(self, value: object) -> None:
        super().__init__(value)


def pages_source(name: str, stores: Sequence[str], fetch: Callable[[str, int], str | None], has_items: Callable[[str], bool], max_pages: int = MAX_PAGES) -> type[DataSource]:
    """A data source (store string, page int, html string) with a partition for each store, which fetches pages until one is empty.

    fetch: (store, page) -> html or None. A store whose fetch fails gives the pages it has: the others are not lost.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> Sequence[InputPartition]:
            return [_Part(s) for s in stores]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for page in range(1, max_pages + 1):
                try:
                    html = fetch(partition.value, page)
                except Exception:  # a failed page ends its store
                    return
                if not html or not has_items(html):
                    return
                yield partition.value, page, html

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "store string, page int, html string"

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Pages


def fetch_pages(spark: SparkSession, stores: Sequence[str], fetch: Callable[[str, int], str | None], has_items: Callable[[str], bool], max_pages: int = MAX_PAGES) -> DataFrame:
    source = pages_source("larder_pages", stores, fetch, has_items, max_pages)
    spark.dataSource.register(source)
    return spark.read.format("larder_pages").load()


def fetch_details(ids: DataFrame, key: str, fetch: Callable[[list], list[str]], batch: int = BATCH) -> DataFrame:
    """(json string) of the details of distinct ids, asked for in batches in the tasks that hold the ids. A batch that fails gives nothing."""

    def ask(frames: Iterator) -> Iterator:
        import pandas as pd

        held: list = []

        def answered(some: list):
            try:
                return pd.DataFrame({"json": fetch(some)})
            except Exception:  # partial data is better than none
                return pd.DataFrame({"json": pd.Series([], dtype=object)})

        for frame in frames:
            held += frame[key].tolist()
            while len(held) >= batch:
                yield answered(held[:batch])
                held = held[batch:]
        if held:
            yield answered(held)

    return ids.select(key).filter(F.col(key).isNotNull()).distinct().mapInPandas(ask, "json string")
