"""Session settings and the shared folder for checkpoints and job output."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the caller of every column call makes building long expressions slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("vacantia")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (builder.config("spark.driver.memory", memory)
            .config("spark.sql.shuffle.partitions", cores)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir. Only a local session that
    has none gets a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="vacantia-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed_at_exit(spark: SparkSession, folder: str) -> None:
    """The folder, which exists, goes when the driver ends; until then results may read it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows once to the shared folder and goes on from there: losing executors loses no
    work, the plan starts anew with known sizes, and later readers scan only their columns. (A
    reliable checkpoint would compute its last stage twice.)"""
    folder = new_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    removed_at_exit(df.sparkSession, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
