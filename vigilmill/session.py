"""Session defaults and the shared folder for intermediate tables.

Iterative operators cut their lineage by writing a Parquet table into the
folder named by ``spark.checkpoint.dir`` and reading it back: the rows survive
the loss of an executor, are compressed, and can be read by column, which an
RDD checkpoint can't.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: dict[str, SparkSession] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vigilmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a session on one machine may lack the setting: it gets a temporary
    folder. On a cluster a missing setting is an error, because a folder of
    the driver's machine would not be seen by executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_call.isDefined():
        return set_by_call.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="vigilmill-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores appended while a column has it already."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer partitions than that.

    Small inputs come in one file, and costly row-wise work would then run in
    one task. Tables with at least as many splits as there are cores stay as
    they are, so at scale this adds no shuffle. For plans of scans and
    projections only: others would be run to count their partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder is the cluster's to clear
        pass


@atexit.register
def _remove_left() -> None:
    for path, spark in list(_LEFT.items()):
        _remove(spark, path)


class Scratch:
    """Intermediate tables of one operator call, in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        _LEFT[self.base] = spark

    def put(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` and return it as read back: lineage ends here."""
        path = f"{self.base}/{label}{self.made}"
        self.made += 1
        df.write.mode("errorifexists").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                _remove(self.spark, path)

    def close(self) -> None:
        """Delete all; only when no returned DataFrame reads from here."""
        _remove(self.spark, self.base)
        _LEFT.pop(self.base, None)
