"""Search results as a Spark data source, format `recorded_search`: JSON files of provider payloads, one file a query, read where the tasks run. Failures are rows, never exceptions.

Options: path (a folder that all executors reach), provider (tavily or brave). A file `<query_id>.json` holds what the provider answered, or {"status": 429, ...} for an answer that was none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query_id string, pos int, url string, title string, content string, score double, published string, error string"
# Where each provider keeps its results, and the names of their fields.
PROVIDERS = {
    "tavily": (("results",), {"url": "url", "title": "title", "content": "content", "published": "published_date"}),
    "brave": (("web", "results"), {"url": "url", "title": "title", "content": "description", "published": "page_age"}),
}


class QueryFile(InputPartition):
    def __init__(self, path: str, query_id: str) -> None:
        self.path, self.query_id = path, query_id


class RecordedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        provider = self.options.get("provider", "tavily")
        if provider not in PROVIDERS:
            raise ValueError(f"unknown provider {provider!r}, known: {sorted(PROVIDERS)}")
        return SearchReader(self.options["path"], provider)


class SearchReader(DataSourceReader):
    def __init__(self, path: str, provider: str) -> None:
        self.path, self.provider = path, provider

    def partitions(self) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = [f for f in files.get_file_info(fs.FileSelector(root)) if f.is_file and f.extension == "json"]
        base = self.path.rstrip("/")
        return [QueryFile(f"{base}/{f.base_name}", f.base_name.removesuffix(".json")) for f in sorted(found, key=lambda f: f.path)] or [QueryFile("", "")]

    def read(self, partition: QueryFile) -> Iterator[tuple]:
        if not partition.path:
            return
        files, path = fs.FileSystem.from_uri(partition.path)
        try:
            with files.open_input_stream(path) as f:
                payload = json.loads(f.read())
            if "status" in payload and not 200 <= int(payload["status"]) < 300:
                raise ValueError(f"status {payload['status']}")
            yield from rows_of(payload, self.provider, partition.query_id)
        except (OSError, ValueError, TypeError) as e:
            yield partition.query_id, None, None, None, None, None, None, str(e)[:200] or type(e).__name__


def rows_of(payload: dict, provider: str, query_id: str) -> list[tuple]:
    """One row for each result with a web address. Titles fall back to the address; a provider without scores gives them by rank among what it returned."""
    where, names = PROVIDERS[provider]
    for key in where:
        payload = payload.get(key) or {}
    results, out = list(payload), []
    for r in results:
        url = r.get(names["url"]) if isinstance(r, dict) else None
        if not isinstance(url, str) or not url.lower().startswith(("http://", "https://")):
            continue
        if provider == "brave":
            score = round(1 - len(out) / len(results), 3)
        else:
            try:
                score = float(r.get("score"))
            except (TypeError, ValueError):
                score = None
        text = lambda k: str(r.get(names[k]) or "")
        out.append((query_id, len(out), url, text("title").strip() or url, text("content"), score, text("published") or None, None))
    return out


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedSearch)
