"""Captured provider items as a data source of Spark: one partition a day, JSON and JSON lines side by side.

A capture is a file whose path names its day (``day=2024-01-31`` or ``..._2024-01-31.json``)
below a folder named like its provider or anywhere below the folder given. Files are found
and opened by pyarrow's file systems, so the folder may lie in any store that those reach.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

DAY = re.compile(r"(\d{4}-\d{2}-\d{2})")
FIELDS = ("id", "title", "description", "body", "url", "published", "source")
# Other names under which providers give the fields.
NAMES = {
    "id": ("id", "news_id", "uid", "guid"), "title": ("title", "headline", "name"), "description": ("description", "snippet", "summary"), "body": ("content", "text", "body"),
    "url": ("link", "url", "news_url"), "published": ("published_at", "published", "date", "datetime", "timestamp"), "source": ("source", "source_name", "site", "publisher"),
}
TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def items_of(raw: bytes) -> Iterator[dict]:
    """The objects of a capture: of an array, of an object's ``items``, ``data`` or ``results``, the object itself, or one a line; lines that are none are passed over."""
    text = raw.decode("utf-8", "replace").strip()
    try:
        whole = json.loads(text) if text else []
    except ValueError:
        whole = []
        for line in text.splitlines():
            try:
                whole.append(json.loads(line))
            except ValueError:
                continue
    if isinstance(whole, dict):
        whole = next((whole[k] for k in ("items", "data", "results") if isinstance(whole.get(k), list)), [whole])
    yield from (x for x in whole if isinstance(x, dict))


def first_filled(item: dict, names: tuple[str, ...]) -> str | None:
    for name in names:
        value = item.get(name)
        if value is not None and str(value).strip():
            return str(value).strip()
    return None


class DayOfCaptures(InputPartition):
    def __init__(self, day: str, files: list[str]):
        self.day, self.files = day, files


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.tests = [(TESTS[k], options[name]) for k, name in ((GreaterThanOrEqual, "start"), (LessThanOrEqual, "end")) if options.get(name)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == ("day",):
                self.tests.append((TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[DayOfCaptures]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        days: dict[str, list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            below = info.path[len(root) :]
            found = DAY.findall(below)
            hidden = any(p.startswith((".", "_")) for p in below.split("/"))
            if info.is_file and found and not hidden and info.path.endswith((".json", ".jsonl")) and all(test(found[-1], value) for test, value in self.tests):
                days.setdefault(found[-1], []).append(info.path)
        return [DayOfCaptures(day, sorted(files)) for day, files in sorted(days.items())]

    def read(self, partition: DayOfCaptures | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # there is no capture
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        seen = set()
        for file in partition.files:
            with system.open_input_stream(file) as stream:
                for item in items_of(stream.read()):
                    row = tuple(first_filled(item, NAMES[f]) for f in FIELDS)
                    mark = (row[0], row[4], (row[1] or "").lower())
                    if mark not in seen:  # a window gives an item once
                        seen.add(mark)
                        yield (partition.day, *row, file.rpartition("/")[2])


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return "day string, " + ", ".join(f"{f} string" for f in FIELDS) + ", file string"

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def captured_items(spark: SparkSession, folder: str, start: str = "", end: str = "") -> DataFrame:
    """Items of the captures of days from start to end (ISO, both included), a partition a day; conditions on ``day`` reach the file list."""
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("captures").options(path=folder, start=start, end=end).load()
