"""Sources that hand out pages, each with the token of the next one: a Python data source, as stream and as batch.

A page is a JSON object {"records": [...], "next": token or absent}. Pages lie in a folder, one below `token=<token>` each, as a service that was asked
for them would have left them; `FolderPages` is the only part that knows this.

The stream's offset is the cursor: the token that was asked for last and is still to come. Spark writes it to the checkpoint before a batch is read
(the cursor is pending) and marks it once the batch is stored (it is committed), so a run that dies between the two reads the same
pages again, and a sink that replaces a batch by its number neither loses nor doubles a row. The driver follows tokens only, each once; records are
read by the tasks, neighbouring pages by one. A batch has a quarter of the pages before it once that is more than `pagesPerBatch`, so batches grow in
number with the logarithm of the chain alone, and never repeat more than a fifth of it. Coverage is complete where a page has no next token, and only there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Tasks of a batch at most, and what part of the pages before it a batch has at least.
TASKS, PART = 64, 4
SCHEMA = "search string, token string, place long, record string, last boolean"


class FolderPages:
    """Pages below a folder of a store that pyarrow reaches."""

    def __init__(self, path: str) -> None:
        self.path = path

    def page(self, token: str) -> dict:
        from pyarrow import fs

        if not re.fullmatch(r"[\w.:-]+", token):
            raise ValueError(f"no token: {token!r}")
        local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", self.path)
        store, base = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(self.path)
        found = [f.path for f in store.get_file_info(fs.FileSelector(f"{base}/token={token}")) if f.is_file and not f.base_name.startswith(("_", "."))]
        if len(found) != 1:
            raise FileNotFoundError(f"{len(found)} files for the page {token} in {self.path}")
        with store.open_input_stream(found[0]) as f:
            page = json.loads(f.read())
        if not isinstance(page.get("records"), list):
            raise ValueError(f"the page {token} has no list of records")
        return page


class Pages(InputPartition):
    def __init__(self, search: str, tokens: list[str]) -> None:
        self.search, self.tokens = search, tokens


def _rows(pages: FolderPages, search: str, token: str) -> Iterator[tuple]:
    """One row a record; a page without records gives one with a null record, so that coverage is known of it too."""
    page = pages.page(token)
    last = not page.get("next")
    for place, record in enumerate(page["records"] or [None]):
        yield (search, token, place, None if record is None else json.dumps(record, ensure_ascii=False), last)


class PagedStream(DataSourceStreamReader):
    """Offsets: {"token": the next page, or None where none is left; "pages": how many were read before it}."""

    def __init__(self, options: dict[str, str]) -> None:
        self.pages, self.first = FolderPages(options["path"]), options["first"]
        self.most = int(options.get("pagesPerBatch", "8"))
        self.at: dict | None = None
        self.planned: tuple[int, list[tuple[str, str | None]]] = (-1, [])

    def initialOffset(self) -> dict:
        return {"token": self.first, "pages": 0}

    def _follow(self, start: dict, most: int) -> list[tuple[str, str | None]]:
        out, token = [], start["token"]
        while token and len(out) < most:
            after = self.pages.page(token).get("next")
            out.append((token, after))
            token = after
        return out

    def latestOffset(self) -> dict:
        start = self.at or self.initialOffset()
        steps = self._follow(start, max(self.most, start["pages"] // PART))
        if steps:
            self.planned = (start["pages"], steps)
        self.at = {"token": steps[-1][1] or None, "pages": start["pages"] + len(steps)} if steps else start
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # After a restart Spark asks for a batch that this reader didn't plan; the tokens between two offsets are the same.
        if self.at is None or self.at["pages"] < end["pages"]:
            self.at = end
        size = end["pages"] - start["pages"]
        first, steps = self.planned
        if first != start["pages"] or len(steps) != size:
            steps = self._follow(start, size)
        tokens, each = [token for token, _ in steps], -(-size // TASKS) or 1
        return [Pages("", tokens[k : k + each]) for k in range(0, len(tokens), each)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for token in partition.tokens:
            yield from _rows(self.pages, partition.search, token)

    def commit(self, end: dict) -> None:
        # The checkpoint's commit log holds the cursor; a service that wants to be told would be told here.
        pass


class PagedSearches(DataSourceReader):
    """Searches {name: first token}, each followed for at most `pages` pages by a task of its own."""

    def __init__(self, options: dict[str, str]) -> None:
        self.pages, self.searches, self.most = FolderPages(options["path"]), json.loads(options["searches"]), int(options.get("pages", "3"))

    def partitions(self) -> list[InputPartition]:
        return [Pages(search, [token]) for search, token in sorted(self.searches.items())]

    def read(self, partition: Pages) -> Iterator[tuple]:
        token, n = partition.tokens[0], 0
        while token and n < self.most:
            yield from _rows(self.pages, partition.search, token)
            token, n = self.pages.page(token).get("next"), n + 1


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_paged"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStream(self.options)

    def reader(self, schema) -> DataSourceReader:
        return PagedSearches(self.options)


def stream(spark: SparkSession, path: str, first: str, pages_per_batch: int = 8) -> DataFrame:
    """SCHEMA rows of the pages from the token `first` on, `pages_per_batch` pages a batch or a quarter of those before it, if that is more."""
    spark.dataSource.register(Paged)
    return spark.readStream.format("tidemark_paged").option("first", first).option("pagesPerBatch", pages_per_batch).load(path)


def searches(spark: SparkSession, path: str, first: dict[str, str], pages: int = 3) -> DataFrame:
    """SCHEMA rows of each search's first pages."""
    spark.dataSource.register(Paged)
    return spark.read.format("tidemark_paged").option("searches", json.dumps(first)).option("pages", pages).load(path)


def drained(pages: DataFrame, table: str, log: str, before_commit=None) -> None:
    """Stores what is there to `table`, one folder a batch, which a batch that is run again replaces. before_commit: called with the number of a
    batch that is stored but not yet committed."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if before_commit:
            before_commit(number)

    query = pages.writeStream.foreachBatch(store).option("checkpointLocation", log).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def coverage(rows: DataFrame) -> DataFrame:
    """(search, pages, records, complete): complete where a page said that none comes after it."""
    return rows.groupBy("search").agg(F.count_distinct("token").alias("pages"), F.count("record").alias("records"), F.bool_or("last").alias("complete"))
