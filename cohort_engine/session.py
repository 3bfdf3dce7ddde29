"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. Joins back to a hot key are split by
# adaptive execution even when that costs one more exchange downstream.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # what a Python worker holds at once: texts are long, and executors have several workers
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def build_session(app_name: str = "cohort_engine", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Create a session; on a cluster leave `master` and the partition count unset."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (builder.config("spark.sql.session.timeZone", "UTC")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, else one in the warehouse.

    Fails on a cluster whose warehouse is a folder of each machine: what one executor writes
    there, no other finds.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if (warehouse.startswith("file:") or ":/" not in warehouse) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/_shared"


def stable(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder, so later passes see the same rows in
    the same partitions whatever executors are lost in between.

    The folder is that of `shared_folder`.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
