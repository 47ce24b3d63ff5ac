"""The append-only answer log: run what is pending, append, resume."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extractions import RESULT, Extractor, extract, pending, system_prompt
from ..schemas import EXTRACTION_LOG
from ..sources.sinks import content_fingerprint, write_json


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log so far; empty if there is none."""
    try:
        return spark.read.schema(EXTRACTION_LOG).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], EXTRACTION_LOG)
        raise


def run_settings(rows: DataFrame, targets: list[str], model_name: str) -> dict:
    """What must be the same for answers to stand in one log."""
    return {
        "version": 1, "prompt_sha256": hashlib.sha256(system_prompt(targets).encode()).hexdigest(), "input": content_fingerprint(rows, ["record_id", "message", "context"]),
        "rows": rows.count(), "targets": targets, "model_name": model_name,
    }


def check_settings(path: str, settings: dict, restart: bool) -> None:
    """Refuse to mix answers of another model, prompt, input or target list."""
    note = path.rstrip("/") + ".settings.json"
    if os.path.exists(note) and not restart:
        with open(note, encoding="utf-8") as f:
            was = json.load(f)
        if odd := sorted(k for k in settings if was.get(k) != settings[k]):
            raise ValueError(f"the log was begun with other settings ({', '.join(odd)}); take another path or restart")
    elif os.path.exists(path) and not restart:
        raise ValueError("the log has no settings beside it; take another path or restart")
    else:
        write_json(settings, note)


def run_pending(rows: DataFrame, path: str, extractor: Extractor, targets: list[str], model_name: str, tasks: int | None = None, restart: bool = False, at_once: int = 1, wait=lambda attempt: None) -> int:
    """Answer all rows without a completed line and append the answers.

    A log goes on only with the settings it was begun with (see run_settings).

    Lines are numbered after the last one, so the newest line of a record is
    the one with the greatest number. Spark commits the appended files as a
    whole: a crash leaves no half line, and the next run takes up what is
    pending. Returns the number of appended lines.
    """
    spark = rows.sparkSession
    check_settings(path, run_settings(rows, targets, model_name), restart)
    log = spark.createDataFrame([], EXTRACTION_LOG) if restart else read_log(spark, path)
    todo = pending(rows, log)
    if tasks:
        todo = todo.repartition(tasks)
    last = log.agg(F.coalesce(F.max("log_line"), F.lit(0))).first()[0]
    out = extract(todo, extractor, targets, model_name, at_once=at_once, wait=wait)
    cols = [c.split()[0] for c in RESULT.split(", ")]
    numbered = out.select((F.lit(last + 1) + F.monotonically_increasing_id()).cast("long").alias("log_line"), *cols)
    before = log.count()
    numbered.write.mode("overwrite" if restart else "append").parquet(path)
    return read_log(spark, path).count() - before
