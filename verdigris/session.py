"""Session settings and the shared folder used for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_folders: dict[str, str] = {}


def build_session(app: str = "verdigris", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings every operator relies on; size settings stay the cluster's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # Keeps the cut of the first n rows per key before the shuffle for every n that the operators offer.
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, taken from ``spark.checkpoint.dir``.

    Only a local-mode session (tests, a laptop) may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="run-verdigris-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Cut lineage through a parquet table in the shared folder, so lost executors cost no recompute.

    With ``partition_by``, a read that filters on that column opens its own folder only.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path).select(*(f"`{column}`" for column in df.columns))
    settled.settled_at = path
    return settled


def settle_in_buckets(df: DataFrame, column: str, name: str = "stage") -> DataFrame:
    """``settle`` in hash buckets of a column: joins by that column then read the table where it lies and shuffle the other side only.

    The catalog knows the table no longer than it takes to read its layout; its files stay like those of ``settle``.
    """
    spark = df.sparkSession
    table = f"settled_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, column).option("path", scratch_path(spark, name)).saveAsTable(table)
    settled = spark.read.table(table)
    spark.sql(f"DROP TABLE {table}")
    return settled


def forget(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more: what was made of them has been settled itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
