"""Sources through Spark's Python data source interface: SQLite tables and paged article services with pushed filters."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual


class SqliteSource(DataSource):
    """spark.read.format("sqlite_table").option("path", file).option("table", name): rows in ranges of rowid, one task each."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        kinds = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            cols = c.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{col[1]}` {next((v for k, v in kinds.items() if k in (col[2] or '').upper()), 'string')}" for col in cols)

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return SqliteReader(dict(self.options), schema)


class RowRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:  # noqa: ANN001
        self.options, self.columns = options, schema.fieldNames()

    def partitions(self) -> list[RowRange]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.options["table"]}"').fetchone()
        if low is None:
            return []
        step = int(self.options.get("rows", 100_000))
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        cols = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            yield from c.execute(f'SELECT {cols} FROM "{self.options["table"]}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class ArticleSource(DataSource):
    """A service that gives articles page by page. fetch is imported by name ("module:function") and takes (page, request); the request holds the pushed filters.

    Without a fetch option pages are files page_<n>.json in `path`, lists of objects.
    """

    FIELDS = ("id", "published", "language", "source", "site_id", "title", "text", "score")

    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return "id string, published string, language string, source string, site_id string, title string, text string, score double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return ArticleReader(dict(self.options))


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


class ArticleReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.request = options, {}

    def pushFilters(self, filters):  # noqa: ANN001, ANN201, N802 - Spark's name
        """Equality on language, source and site, and bounds on the publication time and score, are the service's own filters."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, EqualTo) and name in ("language", "source", "site_id"):
                self.request[name] = f.value
            elif isinstance(f, GreaterThanOrEqual) and name in ("published", "score"):
                self.request[f"{name}_from"] = f.value
            elif isinstance(f, LessThanOrEqual) and name == "published":
                self.request["published_to"] = f.value
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(i) for i in range(int(self.options.get("pages", 1)))]

    def _fetch(self, page: int) -> list[dict]:
        if "fetch" in self.options:
            import importlib

            module, function = self.options["fetch"].split(":")
            return getattr(importlib.import_module(module), function)(page, dict(self.request))
        try:
            with open(f"{self.options['path']}/page_{page}.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return []

    def read(self, partition: Page) -> Iterator[tuple]:
        q = self.request
        for x in self._fetch(partition.number):
            if all(x.get(k) == q[k] for k in ("language", "source", "site_id") if k in q) and (x.get("published") or "") >= q.get("published_from", "") and (x.get("published") or "") <= q.get("published_to", "￿") and ("score_from" not in q or (x.get("score") or 0.0) >= q["score_from"]):
                yield tuple(float(x[k]) if k == "score" and x.get(k) is not None else x.get(k) for k in ArticleSource.FIELDS)


def register(spark) -> None:  # noqa: ANN001
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    spark.dataSource.register(ArticleSource)
