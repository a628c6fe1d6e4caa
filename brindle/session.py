"""Session settings and table access shared by every query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the engine's defaults; used by tests and bench, a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName("brindle")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> list[str]:
    """Temp views for the SQL endpoint; returns the names registered."""
    names = list(names or TABLES)
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return names


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir). In local mode one is made where it is unset; on a
    cluster that would be a folder of each machine's own, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/brindle-tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df through a table in the shared folder: what is read several times is computed once, and lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, "stored")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def stored_bytes(df: DataFrame) -> int | None:
    """Size of the files of a frame made by stored(); None for other frames."""
    path = getattr(df, "_brindle_path", None)
    if not path:
        return None
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def dropped(*frames: DataFrame | None) -> None:
    """Delete the tables of frames made by stored() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_brindle_path", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
