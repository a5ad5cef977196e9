"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small shuffles feed costly expressions here; keep them on all cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.parquet.filterPushdown": "true",
    # Heads of groups are cut before the shuffle whatever their length.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2147483647",
    # Batches sent to Python workers are bounded in bytes, however long the texts in them are.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
    # A key that occurs twice in a record keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on (UTC above all) on an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    _fix_splits(spark)
    return spark


def _fix_splits(spark: SparkSession) -> None:
    """Two scans of one file must cut it alike, also if the number of executors changes in between."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def get_session(app: str = "logsift", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    _fix_splits(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting, as in tests, gets a fresh temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        folder = context.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under the application's id so that leftovers can be told apart."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, keeps column pruning and
    filter pushdown for the readers, and gives Catalyst a measured size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def is_stored(df: DataFrame) -> bool:
    """Whether a table is read from files as it is, at most with columns left out."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        columns = plan.projectList()
        if any(columns.apply(i).getClass().getSimpleName() != "AttributeReference" for i in range(columns.size())):
            return False
        plan = plan.child()
    return plan.nodeName() in ("LogicalRelation", "Relation") and bool(df.inputFiles())


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote; what was made of them must be written already."""
    for df in tables:
        jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jvm_path, True)
