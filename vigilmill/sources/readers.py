"""Readers: JSON lines, CSV, term dictionaries, alias lists, result tables.

Line order matters to keep-first and last-wins rules, and a DataFrame has
none, so readers of line-based files add ``_file`` and ``_pos``: the position
in the file by bytes split and line, which sorts as the lines stand.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["_file", "_pos"]


def text_lines(spark: SparkSession, path: str | list[str], suffix: str = "*.jsonl", parent: str | None = None) -> DataFrame:
    """``value, _file, _pos`` of all non-blank lines below ``path``; with
    ``parent`` only of files whose folder has that name, in any case."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path)
    out = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("_pos"))
    if parent:
        out = out.where(F.lower(F.element_at(F.split("_file", "/"), -2)) == parent.lower())
    return out.where(F.trim("value") != "")


def json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, parent: str | None = None) -> DataFrame:
    """Objects of JSON-lines files as columns of ``schema``, plus ORDER.

    ``strict`` fails the job at a line that is no whole JSON object, naming
    file and line text; otherwise such lines are skipped.
    """
    lines = text_lines(spark, path, parent=parent)
    whole = F.expr("try_parse_json(value)")
    good = whole.isNotNull() & F.trim("value").startswith("{")
    if strict:
        lines = lines.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no JSON object in "), "_file", F.lit(": "), F.left("value", F.lit(120)))).isNull()))
    else:
        lines = lines.where(good)
    return lines.select(F.from_json("value", schema).alias("r"), *ORDER).select("r.*", *ORDER)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all text; empty fields are empty strings."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"').na.fill("")


def input_table(spark: SparkSession, path: str) -> DataFrame:
    """A generic input by suffix: .csv, .jsonl or .ndjson; all text."""
    if path.lower().endswith(".csv"):
        return csv_table(spark, path)
    if path.lower().endswith((".jsonl", ".ndjson")):
        return spark.read.option("primitivesAsString", True).json(path).na.fill("")
    raise ValueError(f"unsupported input: {path}")


def term_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``pt_code, pt_term`` and ORDER of a ``$``-separated Latin-1 file
    without header; further fields are ignored. A code that is no number
    fails the job."""
    raw = spark.read.option("encoding", "ISO-8859-1").text(path)
    part = F.split("value", r"\$")
    where = [F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("_pos")]
    return raw.select(F.trim(F.get(part, F.lit(0))).cast("bigint").alias("pt_code"), F.trim(F.get(part, F.lit(1))).alias("pt_term"), *where).where("pt_term <> ''")


def alias_table(spark: SparkSession, path: str) -> DataFrame:
    """``canonical, aliases`` of a JSON object of lists; a small file that is
    read by the driver. Blank names are dropped, an empty rest is an error."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if not isinstance(data, dict) or not data:
        raise ValueError("the alias file needs a non-empty JSON object")
    rows: dict[str, list[str]] = {}
    for k, v in data.items():
        if not isinstance(v, list):
            raise ValueError(f"aliases of {k} are no list")
        own = [str(x).strip() for x in v if str(x).strip()]
        if str(k).strip() and own:
            rows.setdefault(str(k).strip().lower(), []).extend(own)
    if not rows:
        raise ValueError("no usable aliases")
    return spark.createDataFrame(list(rows.items()), "canonical string, aliases array<string>")


def drug_labels(path: str | None, drugs: Iterable[str], defaults: dict[str, str]) -> dict[str, str]:
    """Label of each drug: the file's, else the default, else the name."""
    own: dict[str, str] = {}
    if path:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if not isinstance(data, dict):
            raise ValueError("the label file needs a JSON object")
        own = {str(k).strip().lower(): str(v).strip() for k, v in data.items() if str(v).strip()}
    return {d: own.get(d, defaults.get(d, d)) for d in drugs}


def extraction_log(spark: SparkSession, path: str) -> DataFrame:
    """The answer log with ``log_line``; only a torn last line of a file is
    dropped, any other line that is no object fails the job."""
    lines = text_lines(spark, path)
    good = F.expr("try_parse_json(value)").isNotNull() & F.trim("value").startswith("{")
    last = lines.groupBy("_file").agg(F.max("_pos").alias("last"))  # one row a file
    marked = lines.join(F.broadcast(last), "_file").withColumn("good", good)
    kept = marked.where(F.when(F.col("good"), F.lit(True)).when(F.col("_pos") == F.col("last"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("bad log line in "), "_file")).isNull()))
    schema = "target_drugs array<string>, record_id string, user_id string, subreddit string, date string, status string, model_name string, extraction string, error string"
    rows = kept.select(F.from_json("value", schema).alias("r"), F.row_number().over(_by_position()).cast("long").alias("log_line"))
    return rows.select("log_line", "r.target_drugs", "r.record_id", "r.user_id", "r.subreddit", F.col("r.date").alias("date_text"), "r.status", "r.model_name", "r.extraction", F.col("r.error").alias("error_text"))


def _by_position():
    from pyspark.sql import Window

    # Lines of one log file; runs append to their own file, so no file is large.
    return Window.partitionBy("_file").orderBy("_pos")


def checked_result(spark: SparkSession, path: str, needed: set[str]) -> DataFrame:
    """A result table read back for statistics; missing columns are an error."""
    df = csv_table(spark, path) if path.lower().endswith(".csv") else spark.read.parquet(path)
    lost = needed - set(df.columns)
    if lost:
        raise ValueError(f"{os.path.basename(path)} lacks columns: {', '.join(sorted(lost))}")
    return df


def count_whole_lines(spark: SparkSession, path: str) -> int:
    """Lines that are whole JSON objects."""
    return text_lines(spark, path).where(F.expr("try_parse_json(value)").isNotNull() & F.trim("value").startswith("{")).count()
