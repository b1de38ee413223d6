"""A data source of JSON lines over HTTP: spark.dataSource.register(HttpJson), then format("http_json").load(url)."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class HttpJson(DataSource):
    """Options: path (one or more addresses, divided by commas; one partition each). A schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"].split(","))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, urls: list[str]):
        self.names, self.urls = schema.names, urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u.strip()) for u in self.urls]

    def read(self, partition: InputPartition):
        with urllib.request.urlopen(partition.value, timeout=60) as lines:
            for line in lines:
                if line.strip():
                    row = json.loads(line)
                    yield tuple(row.get(n) for n in self.names)
