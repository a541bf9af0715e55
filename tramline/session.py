"""Session defaults, and tables that outlive lost executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for tests and for runs on one machine. A cluster brings its own.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "6g",
}


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session on this machine with `LOCAL` and whatever `conf` overrides."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tramline")
    for k, v in {**LOCAL, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (one machine)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = spark.conf.get("tramline.local.dir", None)
        if not at:
            at = tempfile.mkdtemp(prefix="tramline-")
            spark.conf.set("tramline.local.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


#: Bytes of a written table's plan, as Catalyst estimates them, that one task writes at most before tasks grow in number.
TASK_BYTES = 64 << 20
#: Files of a small written table for each core, at most.
FILES_A_CORE = 3


def tasks_for(df: DataFrame) -> int:
    """Tasks that write `df`: enough that none holds more than TASK_BYTES of its estimated size, FILES_A_CORE a core at least."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    few = FILES_A_CORE * max(1, df.sparkSession.sparkContext.defaultParallelism)
    return max(few, min(int(str(size)) // TASK_BYTES + 1, 1 << 30))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts lineage once, computed once, safe against lost executors.

    Partitions beyond `tasks_for(df)` share files, one after the other in a task and without a shuffle, as a file costs its
    store several calls however small it is; a task's share stays bounded, since the number follows the estimated size (for
    joins an overestimate, which leaves the partitions as they are). The table goes with `forget`, or at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.coalesce(tasks_for(df)).write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tramline_path = path
    return out


class Table:
    """A table in the shared folder that several writes fill one after the other; read back as one scan."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema, self.path, self.empty = spark, schema, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", True
        atexit.register(_remove, spark, self.path)

    def append(self, df: DataFrame) -> None:
        df.coalesce(tasks_for(df)).write.mode("append").parquet(self.path)
        self.empty = False

    def forget(self) -> None:
        """Remove the table; its readers must have been written."""
        _remove(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema) if self.empty else self.spark.read.schema(self.schema).parquet(self.path)


def release(spark: SparkSession, pause: float = 1.0) -> None:
    """Let the shuffle files of finished passes go: Spark removes them once the driver's JVM has collected what refers to them, which it may otherwise leave for long.

    Listeners of a query hold on to its plan a moment longer than the query runs, so it takes a second try after a pause.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def forget(*tables: DataFrame) -> None:
    """Remove tables made by `written` whose readers have all been written themselves; other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "_tramline_path", None):
            _remove(df.sparkSession, path)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores added until no column has it (case aside), so helper columns clash with nobody's."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
