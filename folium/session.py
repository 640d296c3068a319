"""Session settings and the one way this library cuts lineage: a Parquet table in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "folium", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster must name one, because executors
    of a cluster cannot read each other's local disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    found = "file://" + tempfile.mkdtemp(prefix="folium-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: A writer's usual row group; a reader cannot split below one.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table just read, dealt out over all cores if its files are too few and too small to occupy them.

    A large table, or one of many files, is returned as it is: its scan is parallel already, and dealing it
    out would only move it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * ROW_GROUP or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt out, by columns if any are given, over all cores before a map that costs much more than their bytes tell.

    Adaptive execution joins small partitions of a shuffle, and would leave such a map to a few tasks. Rows that agree in `by` are in
    one partition: they are dealt by a hash of their own, since Spark leaves a shuffle out that repeats the one below a join on the same
    columns, and adaptive execution may then split that join's large partitions, which no map asks to keep whole.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, F.xxhash64(*by, F.lit("dealt"))) if by else df.repartition(n)


def partitions(df: DataFrame, each: int) -> int:
    """How many partitions the tables that df reads need at `each` bytes of their files, at least the number of cores; tables not read from files count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(sum(size for size in sizes if size < 1 << 50) // each + 1, df.sparkSession.sparkContext.defaultParallelism)


def grouped(df: DataFrame, *by: str, each: int = 4 << 20) -> DataFrame:
    """Rows dealt by columns before windows or groups over them, in partitions of about `each` bytes of the files read.

    The number of shuffle partitions is fixed, so a task's sorts would grow with the input, and spill; and adaptive execution joins
    partitions by their packed bytes, which tell little of what rows become. Windows and groups by these columns, or by more, need no
    further shuffle, and Spark leaves out a second call with the same columns and bytes.
    """
    return df.repartition(partitions(df, each), *by)


def merged(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the documents: sorted and merged, so that no side is collected by the driver.

    Spark judges a side by its packed files and by how many of their columns it takes, and would broadcast millions of narrow rows.
    """
    return df.hint("merge")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Later work starts from the files, so a lost executor costs a re-read and not a recomputation, and the
    planner knows the table's true size. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/folium-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone first
            return
