"""Tables that are changed together: partitions written aside, then named by one new list.

A store is a folder. ``data`` has the folders of partitions, ``commits`` a list for each
commit of which folders make up which table. A commit writes only the partitions that it
touches; it takes effect when its list is renamed into place, so readers see all of it or
nothing, and one that was interrupted leaves the tables as they were. A commit has a token:
what is tried again under a token that is there already changes nothing. One writer at a
time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        target = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(target)) if self.fs.exists(target) else []

    def _commits(self) -> list[str]:
        return [n for n in self._names(f"{self.folder}/commits") if n.endswith(".json")]

    def tables(self) -> dict:
        """By table its schema, and by partition the folders that hold it."""
        last = self._commits()
        if not last:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/commits/{last[-1]}", wholetext=True).first()[0])

    def read(self, table: str, parts: list[str] | None = None) -> DataFrame | None:
        """A table, or those partitions of it alone, of which no other file is opened; None if there's no such table."""
        found = self.tables().get(table)
        return None if found is None else self._rows(found, parts)

    def _rows(self, table: dict, parts: list[str] | None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        folders = [f"{self.folder}/{f}" for p, fs in sorted(table["parts"].items()) if parts is None or p in parts for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def begin(self, token: str) -> Commit | None:
        """A commit to fill, or None if one of that token is done."""
        mark = hashlib.sha256(token.encode()).hexdigest()[:24]
        done = self._commits()
        return None if any(n.endswith(f"-{mark}.json") for n in done) else Commit(self, f"{len(done):09d}-{mark}", self.tables())

    def sweep(self) -> int:
        """Removes folders that the last list doesn't name, as interrupted commits and replaced partitions leave them; how many."""
        used = {f for t in self.tables().values() for fs in t["parts"].values() for f in fs}
        gone = 0
        for commit in self._names(f"{self.folder}/data"):
            for table in self._names(f"{self.folder}/data/{commit}"):
                for part in self._names(f"{self.folder}/data/{commit}/{table}"):
                    at = f"data/{commit}/{table}/{part}"
                    if part.startswith(PART) and at not in used:
                        self.fs.delete(self.path(f"{self.folder}/{at}"), True)
                        gone += 1
        return gone


class Commit:
    def __init__(self, store: Store, name: str, tables: dict):
        self.store, self.name, self.new = store, name, tables
        self.run = uuid.uuid4().hex[:8]

    def _write(self, table: str, rows: DataFrame, by: Column) -> dict[str, str]:
        """Writes rows by partition; the folder of each partition that has any."""
        at = f"data/{self.name}-{self.run}/{table}-{uuid.uuid4().hex[:8]}"
        dealt = rows.withColumn(PART, F.coalesce(by.cast("string"), F.lit("")))
        dealt.write.partitionBy(PART).parquet(f"{self.store.folder}/{at}")
        unquoted = self.store.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        parts = [n for n in self.store._names(f"{self.store.folder}/{at}") if n.startswith(f"{PART}=")]
        return {unquoted(n.removeprefix(f"{PART}=")).replace("__HIVE_DEFAULT_PARTITION__", ""): f"{at}/{n}" for n in parts}

    def _table(self, table: str, rows: DataFrame) -> dict:
        return self.new.setdefault(table, {"schema": rows.schema.jsonValue(), "parts": {}})

    def append(self, table: str, rows: DataFrame, by: Column) -> list[str]:
        """Adds rows to their partitions; which these are."""
        parts = self._table(table, rows)["parts"]
        made = self._write(table, rows, by)
        for p, folder in made.items():
            parts[p] = [*parts.get(p, []), folder]
        return sorted(made)

    def replace(self, table: str, rows: DataFrame, by: Column, parts: list[str]) -> None:
        """Has rows take the place of the partitions named; those without rows are gone."""
        held = self._table(table, rows)["parts"]
        made = self._write(table, rows, by)
        for p in parts:
            held.pop(p, None)
        held.update({p: [folder] for p, folder in made.items()})

    def change(self, table: str, incoming: DataFrame, by: Column, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
        """Rewrites the partitions that incoming rows fall into as ``combine`` makes them of the old rows and the new; which these are.

        The incoming rows are written aside first, so that the partitions are known from
        folders and what makes the rows runs once. ``by`` must depend on what combine keeps together alone.
        """
        held = self._table(table, incoming)
        staged = self._write(f"{table}-incoming", incoming, by)
        if not staged:
            return []
        spark, root = self.store.spark, self.store.folder
        fresh = spark.read.schema(incoming.schema).parquet(*[f"{root}/{f}" for f in staged.values()])
        rows = combine(self.store._rows(held, list(staged)), fresh).select(*T.StructType.fromJson(held["schema"]).fieldNames())
        made = self._write(table, rows, by)
        for p in staged:
            held["parts"].pop(p, None)
        held["parts"].update({p: [folder] for p, folder in made.items()})
        self.store.fs.delete(self.store.path(f"{root}/{next(iter(staged.values())).rpartition('/')[0]}"), True)  # what was aside is in the rows by now
        return sorted(staged)

    def merge(self, table: str, incoming: DataFrame, by: Column, key: list[str], ordinal: str, kept: tuple[str, ...] = ()) -> list[str]:
        """Upserts by key: incoming rows win, of several the last by ordinal; columns ``kept`` stay as they were stored first."""

        def combine(old: DataFrame, new: DataFrame) -> DataFrame:
            both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            w = Window.partitionBy(*key)
            first = {c: F.coalesce(F.max(F.when(F.col("_new") == 0, F.col(c))).over(w), F.col(c)) for c in kept}
            ranked = both.withColumns(first | {"_rank": F.row_number().over(w.orderBy(F.desc("_new"), F.desc(ordinal)))})
            return ranked.where("_rank = 1").drop("_new", "_rank")

        return self.change(table, incoming, by, combine)

    def finish(self) -> None:
        """Makes all of the commit's changes visible at once."""
        fs, path, root = self.store.fs, self.store.path, self.store.folder
        fs.mkdirs(path(f"{root}/commits"))
        aside = path(f"{root}/commits/.{self.name}-{self.run}")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(self.new).encode()))
        finally:
            out.close()
        if not fs.rename(aside, path(f"{root}/commits/{self.name}.json")):
            raise RuntimeError(f"commit {self.name} is there already")


def bucket(*key: str, of: int = 64) -> Column:
    """A partition by a key's hash."""
    return F.pmod(F.xxhash64(*key), F.lit(of))


#: By table: key, the column by which the last of several rows counts, the columns by which it's dealt, and what keeps its first value.
KEYED = {
    "metrics": (["metric_row_id"], "updated_at", ["company"], ("created_at",)),
    "statement_integrity": (["file", "statement_period_end"], "updated_at", ["file"], ("created_at",)),
    "derived_metrics": (["derived_row_id"], "updated_at", ["company"], ("created_at",)),
    "risk_signals": (["file", "statement_period_end", "signal_name"], "updated_at", ["file"], ("created_at",)),
    "article_sentiment": (["article_key"], "updated_at", ["article_key"], ("created_at",)),
    "ticker_sentiment": (["as_of_date", "ticker", "window_days"], "updated_at", ["ticker"], ("created_at",)),
}


def upsert(store: Store, token: str, of: int = 64, **tables: DataFrame) -> bool:
    """Merges rows into tables of ``KEYED`` in one commit; False if the token's commit is done already.

    Only partitions of incoming rows are read and written again.
    """
    commit = store.begin(token)
    if commit is None:
        return False
    for name, rows in tables.items():
        key, ordinal, dealt, kept = KEYED[name]
        commit.merge(name, rows, bucket(*dealt, of=of), key, ordinal, kept)
    commit.finish()
    return True


def json_report(summaries: DataFrame, folder: str, **head: object) -> None:
    """Summaries as lines of JSON below ``companies``, and one line with the head and their number below ``report``."""
    summaries.write.mode("overwrite").json(f"{folder}/companies")
    n = summaries.sparkSession.read.schema(summaries.schema).json(f"{folder}/companies").agg(F.count("*").alias("company_count"))
    n.withColumns({k: F.lit(v) for k, v in head.items()}).write.mode("overwrite").json(f"{folder}/report")


def csv_report(rows: DataFrame, folder: str, columns: list[str]) -> None:
    """Rows as CSV with a header, the columns in this order; absent ones are empty."""
    some = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]
    rows.select(*some).write.mode("overwrite").option("header", True).csv(folder)
