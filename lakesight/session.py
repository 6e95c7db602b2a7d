"""Session factory, object-store settings and the checkpoint location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# S3A settings that must be plain numbers, because some readers
# reject the "30s" / "24h" spellings of the Hadoop defaults.
S3A_NUMERIC_OVERRIDES = {
    "spark.hadoop.fs.s3a.connection.establish.timeout": "5000",
    "spark.hadoop.fs.s3a.connection.timeout": "60000",
    "spark.hadoop.fs.s3a.threads.keepalivetime": "60",
    "spark.hadoop.fs.s3a.multipart.purge.age": "86400",
    "spark.hadoop.fs.s3a.multipart.uploads.expiration": "86400",
    "spark.hadoop.fs.s3a.connection.maximum": "15",
    "spark.hadoop.fs.s3a.attempts.maximum": "3",
    "spark.hadoop.fs.s3a.retry.interval": "1000",
    "spark.hadoop.fs.s3a.threads.max": "10",
    "spark.hadoop.fs.s3a.threads.core": "5",
    "spark.hadoop.fs.s3a.fast.upload": "true",
    "spark.hadoop.fs.s3a.block.size": "134217728",
}

# Connector classes and credential chain per cloud.
GCS_CONNECTOR = {
    "spark.hadoop.fs.gs.impl": "com.google.cloud.hadoop.fs.gcs.GoogleHadoopFileSystem",
    "spark.hadoop.fs.AbstractFileSystem.gs.impl": "com.google.cloud.hadoop.fs.gcs.GoogleHadoopFS",
}
S3A_CREDENTIAL_CHAIN = (
    "com.amazonaws.auth.ContainerCredentialsProvider,"
    "com.amazonaws.auth.DefaultAWSCredentialsProviderChain"
)
DELTA_CATALOG = {
    "spark.sql.extensions": "io.delta.sql.DeltaSparkSessionExtension",
    "spark.sql.catalog.spark_catalog": "org.apache.spark.sql.delta.catalog.DeltaCatalog",
}

# Adaptive execution does the runtime work: coalescing small shuffle partitions,
# splitting skewed join partitions and switching join strategy by measured size.
ENGINE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def spark_path(path: str) -> str:
    """Rewrite the ``s3://`` scheme to the one Hadoop's connector registers."""
    scheme = "s3://"
    return "s3a://" + path[len(scheme):] if path.startswith(scheme) else path


def session_settings(cloud: str = "", region: str | None = None, delta: bool = False) -> dict[str, str]:
    """Settings for one deployment target: ``aws``, ``gcp`` or local (empty)."""
    settings = dict(ENGINE_DEFAULTS)
    if delta:
        settings.update(DELTA_CATALOG)
    if cloud.lower() == "gcp":
        settings.update(GCS_CONNECTOR)
    elif cloud.lower() == "aws":
        settings["spark.hadoop.fs.s3a.endpoint.region"] = region or "us-east-1"
        settings["spark.hadoop.fs.s3a.aws.credentials.provider"] = S3A_CREDENTIAL_CHAIN
        settings.update(S3A_NUMERIC_OVERRIDES)
    return settings


def build_session(
    app_name: str = "lakesight",
    master: str | None = None,
    cloud: str = "",
    region: str | None = None,
    delta: bool = False,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**session_settings(cloud, region, delta), **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only acceptable when the whole application is one
    local process, so it is the fallback for ``local`` masters alone.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lakesight-"))
    return context.getCheckpointDir()


def application_folder(spark: SparkSession, name: str) -> str:
    """A folder of this name in the shared location, under one of this application that goes when it ends."""
    own = f"{shared_dir(spark).rstrip('/')}/lakesight/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{own}/{name}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of this application."""
    return application_folder(spark, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write once and read back: cuts the lineage and outlives lost executors."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
