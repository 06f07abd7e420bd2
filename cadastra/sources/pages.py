"""Paged sources by the Python data source API: a table of one pinned version by offset, and an outbox by cursor.

Pages are JSON files of what the service answers, wherever pyarrow can open them; each page is a partition of its own.

    spark.dataSource.register(PagedTable)
    spark.read.format("cadastra_pages").schema(...).option("path", folder).option("version", "7").option("total", 1000).load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

PAGE, MOST_PAGES = 200, 20


class PageError(ValueError):
    """A page is not the one that was asked for."""


def fetch(path: str) -> dict | None:
    """The page at a path or URI; None if there is none."""
    files, place = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))
    if files.get_file_info(place).type != pyarrow.fs.FileType.File:
        return None
    with files.open_input_stream(place) as stream:
        return json.loads(stream.read())


def _row(item: dict, schema: StructType) -> tuple:
    """An item's fields in the schema's order; nested values as JSON text where the schema says string."""
    values = (item.get(f.name) for f in schema.fields)
    return tuple(json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) and f.dataType.typeName() == "string" else v for v, f in zip(values, schema.fields))


class Offset(InputPartition):
    def __init__(self, start: int, rows: int):
        super().__init__(start)
        self.start, self.rows = start, rows


class PagedTable(DataSource):
    """Options: path (files `<offset>.json`), version, total, page (rows of a page), and scope with scopeRevision if it has one."""

    @classmethod
    def name(cls) -> str:
        return "cadastra_pages"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(schema, self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"].rstrip("/")
        self.expected = {"version": options["version"], "total": int(options["total"])}
        if options.get("scope"):
            self.expected |= {"scope": options["scope"], "scope_revision": options.get("scoperevision") or options.get("scopeRevision")}
        self.page = int(options.get("page", PAGE))
        if self.expected["total"] < 0 or self.page < 1:
            raise PageError("total and page are whole numbers")

    def partitions(self) -> list[Offset]:
        """One a page; a table of no rows is not asked for."""
        total = self.expected["total"]
        return [Offset(start, min(self.page, total - start)) for start in range(0, total, self.page)]

    def read(self, partition: Offset | None) -> Iterator[tuple]:
        if partition is None or not hasattr(partition, "start"):
            return
        found = fetch(f"{self.path}/{partition.start}.json")
        if found is None:
            raise PageError(f"there is no page at {partition.start}")
        for name, value in self.expected.items():
            if str(found.get(name)) != str(value):
                raise PageError(f"{name} drifted at {partition.start}: {found.get(name)!r}, not {value!r}")
        rows = found.get("rows")
        if not isinstance(rows, list) or len(rows) != partition.rows:
            raise PageError(f"the page at {partition.start} has {len(rows) if isinstance(rows, list) else 'no'} rows, not {partition.rows}")
        yield from (_row(item, self.schema) for item in rows)


class OutboxPages(DataSource):
    """Options: path (files `<after_id>.json` with results, count, has_more, next_after_id), key (the id's field), pages (of a batch)."""

    @classmethod
    def name(cls) -> str:
        return "cadastra_outbox"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _OutboxReader(schema, self.options)


class _OutboxReader(SimpleDataSourceStreamReader):
    """Reads on from a cursor: at most so many pages of at most PAGE rows a batch, ids ascending over all of them."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.key = schema, options["path"].rstrip("/"), options.get("key", "outbox_id")
        self.most = int(options.get("pages", MOST_PAGES))

    def initialOffset(self) -> dict:
        return {"after_id": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return self._pages(start["after_id"], None)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._pages(start["after_id"], end["after_id"])[0]

    def _pages(self, after: int, until: int | None) -> tuple[Iterator[tuple], dict]:
        rows: list[tuple] = []
        for _ in range(self.most):
            found = None if until is not None and after >= until else fetch(f"{self.path}/{after}.json")
            if found is None:
                break
            items = found.get("results")
            if not isinstance(items, list) or len(items) > PAGE or found.get("count") != len(items):
                raise PageError(f"the page after {after} is not one")
            if not items:
                break
            ids = [item.get(self.key) if isinstance(item, dict) else None for item in items]
            if any(type(i) is not int for i in ids) or any(b <= a for a, b in zip([after, *ids], ids)):
                raise PageError(f"ids after {after} do not ascend")
            rows += [_row(item, self.schema) for item in items]
            if found.get("has_more") and found.get("next_after_id") != ids[-1]:
                raise PageError(f"the cursor after {after} is not the page's last id")
            after = ids[-1]
            if not found.get("has_more"):
                break
        return iter(rows), {"after_id": after}
