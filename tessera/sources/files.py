"""Rows of local or shared files: JSON, CSV, lists of symbols, identities, labels, and lines that hold a word.

Schemas are given, not guessed, so that a reader never passes over the data twice and a
missing column is null and no error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_declared(rows: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """rows with just the columns of a schema, in its order and types; those that are absent have their default or null, in any case of letters."""
    have = {c.lower(): c for c in rows.columns}
    want = T._parse_datatype_string(schema)
    defaults = defaults or {}

    def one(f: T.StructField) -> Column:
        x = rows[have[f.name.lower()]] if f.name.lower() in have else F.lit(None)
        x = x.try_cast(f.dataType) if f.name.lower() in have else x.cast(f.dataType)
        return (F.coalesce(x, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else x).alias(f.name)

    return rows.select(*[one(f) for f in want.fields])


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that each hold a JSON array or object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files or folders of JSON lines; lines that aren't JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)


def csv_rows(spark: SparkSession, path: str, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Rows of CSV files with a header, matched by name: columns may be missing, more or in another order."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return as_declared(raw, schema, defaults)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As csv_rows, or no rows where there's no such file."""
    return csv_rows(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def report_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size, modified) of all files below a folder whose name fits; their content isn't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def universe(lines: DataFrame, line: str = "value") -> DataFrame:
    """(ticker, place) of lines of symbols: what follows # and signs are left out, the first of repeated ones counts."""
    numbered = lines.select(F.monotonically_increasing_id().alias("place"), F.regexp_replace(F.upper(F.trim(F.split(line, "#", 2)[0])), "[^A-Z0-9]", "").alias("ticker"))
    return numbered.where("ticker <> ''").groupBy("ticker").agg(F.min("place").alias("place"))


def ticker_universe(spark: SparkSession, path: str) -> DataFrame:
    return universe(spark.read.text(path))


IDENTITY = "map<string, struct<canonical_names: array<string>, aliases: array<string>>>"


def identities(documents: DataFrame, text: str) -> DataFrame:
    """(ticker, kind, name) of JSON objects of tickers with their canonical names and aliases; blanks are left out."""
    entry = documents.select(F.explode(F.from_json(text, IDENTITY)).alias("ticker", "e"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col("e")[k], F.array().cast("array<string>")).alias("names")) for k in ("canonical_names", "aliases")])
    named = entry.select(F.upper(F.trim("ticker")).alias("ticker"), F.explode(kinds).alias("k")).select("ticker", "k.kind", F.explode("k.names").alias("name"))
    return named.select("ticker", "kind", F.trim("name").alias("name")).where("ticker <> '' and name <> ''").distinct()


def identity_map(spark: SparkSession, path: str) -> DataFrame:
    return identities(spark.read.text(path, wholetext=True), "value")


LABELS = "doc_id string, ticker string, pdf_sha256 string, published_at string, fields array<struct<metric: string, period_end: string, period_type: string, value: string, unit_scale: double, currency: string, scope: string, statement_type: string, source_hint: string>>"


def labelled_fields(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each labelled field of a folder of JSON documents, with its place in its document."""
    docs = json_rows(spark, folder, LABELS).where("fields is not null")
    return docs.select("doc_id", "ticker", F.posexplode("fields").alias("place", "f")).select("doc_id", "ticker", "place", "f.*")


def matching_lines(spark: SparkSession, folder: str, words: str, most: int = 50, pattern: str = "*") -> DataFrame:
    """(path, line) of the lines of files below a folder that hold the words, in any case of letters; at most so many, in order of path and line."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    found = rows.where(F.contains(F.lower("value"), F.lit(words.lower()))).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return found.orderBy("path", "line").limit(most)


def training_rows(rows: DataFrame, folder: str) -> None:
    """Writes rows as JSON lines, one file a task; Spark's committer leaves whole files only."""
    rows.write.mode("overwrite").json(folder)
