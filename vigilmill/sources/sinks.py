"""Writers: tables, small CSV files, manifests with summaries, charts."""

from __future__ import annotations

import hashlib
import json
import os
import re
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NOTICE
from ..operators import localize, recall

#: Rows of a result that is written as one file by the driver; larger ones are written by Spark.
SMALL = 100_000


def write_json(data: Any, path: str) -> None:
    """JSON by way of a temporary file, so readers never see half of it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(path + ".tmp", path)


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as one CSV file; of more than SMALL rows, as a folder."""
    rows = df.limit(SMALL + 1).toPandas()
    if len(rows) > SMALL:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    rows.to_csv(path + ".tmp", index=False, encoding="utf-8-sig")
    os.replace(path + ".tmp", path)


def write_bilingual(df: DataFrame, path: str, drugs: dict[str, str]) -> None:
    """``path`` and its ``_en`` and ``_zh`` forms."""
    stem, ext = os.path.splitext(path)
    write_csv(df, path)
    write_csv(df, f"{stem}_en{ext}")
    write_csv(localize.chinese(df, drugs), f"{stem}_zh{ext}")


def append_slices(df: DataFrame, path: str) -> None:
    """Ingested records, one folder per community; threads are a column."""
    df.write.mode("append").partitionBy("subreddit").parquet(path)


def fingerprint(parameters: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def content_fingerprint(df: DataFrame, cols: list[str]) -> str:
    """Order-free fingerprint of a table: row count and sum of row hashes."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{r[0]}:{r[1]}".encode()).hexdigest()


def write_recall(recalled: DataFrame, path: str, parameters: dict[str, Any]) -> dict[str, Any]:
    """Manifest (Parquet) and summary (JSON) of a recall; both or none stay."""
    recalled.write.mode("overwrite").parquet(f"{path}/manifest")
    back = recalled.sparkSession.read.parquet(f"{path}/manifest")
    flags = back.transform(recall.match_flags).first().asDict()
    summary = {
        "notice": NOTICE, "parameters": parameters, "fingerprint": fingerprint(parameters), **flags,
        "by_drug": {r[0]: r[1] for r in recall.by_drug(back).collect()},
        "by_mention_set": {r[0]: r[1] for r in recall.by_mention_set(back).collect()},
        "matched_terms": [r.asDict() for r in recall.matched_terms(back).limit(SMALL).collect()],
    }
    write_json(summary, f"{path}/summary.json")
    return summary


def saved_recall(spark, path: str, parameters: dict[str, Any]) -> DataFrame | None:
    """A saved manifest, if it was made with the same parameters and is whole."""
    have = os.path.exists(f"{path}/summary.json"), os.path.exists(f"{path}/manifest/_SUCCESS")
    if have == (False, False):
        return None
    if have != (True, True):
        raise ValueError("manifest and summary must exist both or not at all")
    with open(f"{path}/summary.json", encoding="utf-8") as f:
        summary = json.load(f)
    if summary["fingerprint"] != fingerprint(parameters):
        return None
    df = spark.read.parquet(f"{path}/manifest")
    n, ids = df.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n != summary["n_records"] or ids != n:
        raise ValueError("the manifest doesn't agree with its summary")
    return df


@contextmanager
def folder_lock(path: str):
    """One writer per output folder; a second one fails at once."""
    os.makedirs(path, exist_ok=True)
    name = os.path.join(path, ".lock")
    try:
        fd = os.open(name, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError as e:
        raise RuntimeError(f"another run writes to {path}") from e
    try:
        os.write(fd, str(os.getpid()).encode())
        os.close(fd)
        yield
    finally:
        os.unlink(name)


def chart_name(group: str) -> str:
    return re.sub(r"[^a-z0-9]+", "__", group.casefold()).strip("_") or "group"


def top_charts(top: DataFrame, folder: str, least_users: int = 1) -> list[str]:
    """A bar chart (SVG) per exposure group of at most ten terms each; the
    rows are collected group by group size, ten a group."""
    by: dict[str, list] = {}
    for r in top.where(F.col("n_exposed_users") >= least_users).orderBy("exposure_group", "term_rank").collect():
        by.setdefault(r["exposure_group"], []).append(r)
    out = []
    for group, rows in by.items():
        sub = "single" if rows[0]["group_type"] == "single" else "combinations"
        os.makedirs(f"{folder}/{sub}", exist_ok=True)
        most = max(r["n_users"] for r in rows)
        esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;")
        bars = "".join(
            f'<text x="190" y="{58 + 26 * i}" text-anchor="end">{esc(r["meddra_pt"])}</text><rect x="200" y="{44 + 26 * i}" width="{360 * r["n_users"] / most:.1f}" height="18" fill="#4477aa"/>'
            f'<text x="{206 + 360 * r["n_users"] / most:.1f}" y="{58 + 26 * i}">{r["n_users"]} ({r["percent_of_exposed_users"]}%)</text>'
            for i, r in enumerate(rows)
        )
        foot = f'{rows[0]["n_exposed_users"]} exposed users, {rows[0]["n_event_users"]} with events. {NOTICE}'
        path = f"{folder}/{sub}/{chart_name(group)}_top10.svg"
        with open(path, "w", encoding="utf-8") as f:
            f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="760" height="{90 + 26 * len(rows)}" font-family="sans-serif" font-size="13"><text x="20" y="24" font-size="16">{esc(group)}</text>{bars}<text x="20" y="{76 + 26 * len(rows)}" font-size="10">{esc(foot)}</text></svg>')
        out.append(path)
    return out
