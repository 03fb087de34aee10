"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import PipelineError


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is tested under.

    Nothing in the package depends on them: every operator also runs in a session
    made elsewhere. Shuffle width is left to the cluster; AQE coalesces it.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise PipelineError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of it, by default in the shared folder.

    Later reads start from the files, whatever happens to executors meanwhile, and still
    prune columns and push filters. Tables stay until someone deletes the folder named
    after the application, since lazy plans may still read them.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/millrace-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
