"""Study periods cut into yearly slices, and the plan of ingestion jobs."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


def slice_bounds(start: int, end: int) -> list[tuple[int, int]]:
    """Half-open slices of [start, end), cut at each 1 January, UTC."""
    if end <= start:
        return []
    first, last = datetime.fromtimestamp(start, UTC).year, datetime.fromtimestamp(end - 1, UTC).year
    cuts = [start, *(int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in range(first + 1, last + 1)), end]
    return list(zip(cuts, cuts[1:], strict=False))


def year_slices(spark: SparkSession, start: int, end: int) -> DataFrame:
    """The slices as a table; years are generated by Spark."""
    return spark.sql(
        f"""SELECT CAST(y AS INT) AS slice_year, greatest({start}L, unix_seconds(make_timestamp(y, 1, 1, 0, 0, 0, 'UTC'))) AS start_at,
        least({end}L, unix_seconds(make_timestamp(y + 1, 1, 1, 0, 0, 0, 'UTC'))) AS end_at
        FROM (SELECT explode(sequence(year(timestamp_seconds({start}L)), year(timestamp_seconds({end - 1}L)))) AS y) WHERE {end}L > {start}L"""
    )


def plan_jobs(spark: SparkSession, communities: list[str], kinds: list[str], start: int, end: int) -> DataFrame:
    """``job_no, community, kind, slice_year, start_at, end_at``: every kind
    and slice of every community, each listed once (case and ``r/`` ignored,
    first spelling kept)."""
    seen: dict[str, str] = {}
    for c in communities:
        name = c.strip().removeprefix("/").removeprefix("r/").strip()
        if name:
            seen.setdefault(name.casefold(), name)
    rows, n = [], 0
    for c in seen.values():
        for k in kinds:
            for a, z in slice_bounds(start, end):
                n += 1
                rows.append((n, c, k, datetime.fromtimestamp(a, UTC).year, a, z))
    return spark.createDataFrame(rows, "job_no int, community string, kind string, slice_year int, start_at bigint, end_at bigint")
