"""Cutting lineage between rounds of iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that they need not have
    it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        home = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="lineagelake-")) / "lineagelake.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        spark.sparkContext.addPyFile(str(archive))  # Spark copies it to every executor


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster
    names one.  Only on a single machine, as in tests, a temporary folder takes its place."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lineagelake-")
        named = _own[app]
    return named.rstrip("/")


def stored(df: DataFrame, name: str, **seen: Column) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends
    there, so a lost executor costs a re-read, and every reader prunes columns.  Spark
    removes the files when the application ends.  Aggregates ``seen`` are observed as the rows
    are written, and are what the frame's ``seen`` says."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    schema, observed = df.schema, Observation()
    if seen:
        df = df.observe(observed, *[c.alias(k) for k, c in seen.items()])
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at, out.seen = path, observed.get if seen else {}
    return out


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """``df`` with its rows numbered from 0 in ``order``; which of equal rows comes first is
    fixed by where they stand.

    Rows are dealt by ranges of the order and numbered within each range; only the sizes of
    the ranges come together, so no task sees all rows, nor all rows of one value.
    """
    rows = df.withColumn("__at", F.monotonically_increasing_id())
    dealt = stored(rows.repartitionByRange(*order, "__at").withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order, "__at"))
    out = dealt.withColumn("__rank", rank).join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return out.select(*df.columns, (F.col("__before") + F.col("__rank") - 1).cast("long").alias(name))


def running(df: DataFrame, order: list[str], of: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``of`` over the rows before a row in ``order``, which
    tells every two rows apart.  As ``numbered``, it goes by ranges: sums within each, and the
    sums of earlier ranges."""
    dealt = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.sum(of).alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("__in", F.coalesce(F.sum(of).over(within), F.lit(0))).join(F.broadcast(sizes), "__range")
    return out.select(*df.columns, (F.col("__before") + F.col("__in")).cast("long").alias(name))


def spread(df: DataFrame, cores: int | None = None) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it has fewer: for rows of a few
    large or compressed files with much work on each row.  Spark would move a later filter
    with that work back before the exchange; columns that depend on a row's place stay
    behind it, and so does what is made of them."""
    cores = cores or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    here = F.monotonically_increasing_id() >= 0  # true
    return df.repartition(cores).select(*[F.when(here, F.col(f"`{c}`")).alias(c) for c in df.columns])


def free(*frames: DataFrame) -> None:
    """Delete the files of frames that ``stored`` returned and nothing reads any more."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
