"""Session settings, table access and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a side is broadcast after its rows were counted.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, name: str = "stratalog") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local master may go without it and then gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = set_before.get() if set_before.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalog-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.is_cut = True
    return made


def once(df: DataFrame, label: str) -> DataFrame:
    """df itself if it is such a table already, else cut."""
    return df if getattr(df, "is_cut", False) is True else cut(df, label)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application; results not yet written out are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/stratalog-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must to know."""
    return df.limit(rows + 1).count() <= rows
