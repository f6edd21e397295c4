"""Session settings and the shared work folder used by streaming jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # The JVM never compiles methods of more than 8000 bytes, as parsing and classifying make in whole stages.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, *, app: str = "hitledger", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_engine_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator assumes on a session built elsewhere."""
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared folder that ``spark.checkpoint.dir`` names.

    Where the session names none, which only a single machine may do, one below the system's temporary
    folder is set for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/hitledger-{purpose}-{uuid.uuid4().hex[:12]}"
