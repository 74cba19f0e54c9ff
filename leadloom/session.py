"""Session helpers: a default session and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on.  Adaptive execution sizes shuffle partitions and splits skewed
# join partitions at run time, so no operator fixes a partition count.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("leadloom")
    for key, value in {"spark.driver.memory": "8g", **RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the shared location the cluster names in `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder of this machine; on a cluster the
    setting is required because executors on other machines must see the files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # a local cluster has executors of its own, which need not see this folder
        if not spark.sparkContext.master.startswith("local[") and (
            spark.sparkContext.master != "local"
        ):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="leadloom-")
    return f"{root.rstrip('/')}/leadloom/{purpose}-{uuid.uuid4().hex}"
