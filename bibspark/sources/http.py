"""Asking catalogues over HTTP: one request, a snapshot of a table of requests, and a data source.

A response counts if its status is 200; any other, and any failure, is no answer. Nothing is asked twice. Requests are spread over
tasks, and a task waits between its requests, as catalogues ask their users to.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bibspark.sources.bib import RESPONSE, fetch
from bibspark.storage import materialize

#: Seconds to connect and to wait for bytes, and between two requests of a task.
TIMEOUT, PAUSE = 10.0, 0.15
AGENT = "bibspark (mailto:academic@example.com)"


class _Redirects(urllib.request.HTTPRedirectHandler):
    """Followed, but never from https to http."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if req.full_url.lower().startswith("https:") and newurl.lower().startswith("http:"):
            return None
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def get(url: str, timeout: float = TIMEOUT, agent: str = AGENT) -> tuple[int, str | None]:
    """(status, body) of a GET; (0, None) without a response, or if it takes longer than ``timeout``."""
    ends = time.monotonic() + timeout
    try:
        request = urllib.request.Request(url, headers={"User-Agent": agent})
        with urllib.request.build_opener(_Redirects).open(request, timeout=timeout) as answer:
            parts = []
            while part := answer.read1(1 << 16):
                parts.append(part)
                if time.monotonic() > ends:
                    return 0, None
            return answer.status, b"".join(parts).decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None
    except (OSError, ValueError, LookupError):  # no connection, no such address, a timeout, an unknown charset
        return 0, None


class Polite:
    """``get`` with a pause between requests."""

    def __init__(self, pause: float = PAUSE, timeout: float = TIMEOUT) -> None:
        self.pause, self.timeout = pause, timeout

    def __call__(self, url: str) -> tuple[int, str | None]:
        time.sleep(self.pause)
        return get(url, self.timeout)


def snapshot(requests: DataFrame, tasks: int = 8, pause: float = PAUSE, timeout: float = TIMEOUT) -> DataFrame:
    """The answers to ``requests`` (source, lookup_kind, lookup_key, url), written once: equal requests are sent once, each by one of
    ``tasks`` tasks."""
    columns = ["source", "lookup_kind", "lookup_key", "url"]
    once = requests.select(*columns).where("url IS NOT NULL").dropDuplicates(columns).repartition(tasks, "url")
    return materialize(fetch(once, Polite(pause, timeout)).where("status = 200"), "snapshot")


class _Part(InputPartition):
    def __init__(self, requests: list) -> None:
        self.requests = requests


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.requests = json.loads(options.get("requests", "[]"))
        self.count = max(1, int(options.get("partitions", "8")))
        self.ask = Polite(float(options.get("pause", PAUSE)), float(options.get("timeout", TIMEOUT)))

    def partitions(self) -> list[InputPartition]:
        return [_Part(self.requests[i :: self.count]) for i in range(min(self.count, len(self.requests)))] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        for source, kind, key, url in partition.requests:
            status, body = self.ask(url)
            if status == 200:
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([kind]), pa.array([key]), pa.array([status], pa.int32()), pa.array([body])], ["source", "lookup_kind", "lookup_key", "status", "body"])


class CatalogueSource(DataSource):
    """``spark.read.format("catalogue")``: the answers to a list of requests, for lists that fit an option; ``snapshot`` asks for those of
    a table. Options: requests (JSON: a list of [source, lookup_kind, lookup_key, url]), partitions, pause, timeout."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def ask(spark: SparkSession, requests: list[tuple[str, str, str, str]], **options) -> DataFrame:
    """``CatalogueSource`` of a list of requests."""
    spark.dataSource.register(CatalogueSource)
    reader = spark.read.format("catalogue").option("requests", json.dumps([list(r) for r in requests]))
    return reader.options(**options).load()
