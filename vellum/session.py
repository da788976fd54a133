"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "vellum", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tested under.

    On a cluster leave ``master`` unset and let spark-submit choose it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset (local tests) a temporary
    folder is made and remembered in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = spark.conf.get("vellum.scratch.dir", None)
        if not root:
            root = tempfile.mkdtemp(prefix="vellum-")
            spark.conf.set("vellum.scratch.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root; nothing is ever overwritten."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
