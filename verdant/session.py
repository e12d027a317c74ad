"""Session helpers.

On a cluster the session is built by the platform; ``get_session`` only fills
in what is unset, so tests and the bench get the same settings as production
would want (AQE on, UTC, no UI).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Skip per-call Python call-site capture (error-message context only);
    # it costs a stack walk and a JVM round trip on every API call.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "verdant", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, scratch tables and streaming state.

    Uses ``spark.checkpoint.dir`` from the session. Only a local-mode session
    (tests, bench) may fall back to a fresh temporary folder; a cluster
    session without the setting is an error, since a machine-local folder
    does not survive executor loss.
    """
    root = resolve_checkpoint_root(spark.conf.get("spark.checkpoint.dir", None),
                                   spark.sparkContext.master or "")
    if root is None:
        root = tempfile.mkdtemp(prefix="verdant-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def resolve_checkpoint_root(configured: str | None, master: str) -> str | None:
    """The configured folder; None when a local session may use a temporary
    one; an error for a cluster session without a configured folder."""
    if configured:
        return configured.rstrip("/")
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return None


def materialize(df, name: str):
    """Write ``df`` once as a table under the shared checkpoint folder and
    read it back: later readers share one computation and the lineage is cut
    (survives executor loss)."""
    import uuid

    path = os.path.join(checkpoint_root(df.sparkSession), name, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
