"""Session settings that suit the engine; a cluster's own settings win."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("tamis")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        defaults["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df computed once into spark.checkpoint.dir, so that what reads it several times does not repeat its plan.

    On one machine a folder of our own serves where none is named, until the process ends; on a cluster without the
    setting df stays as it is."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                return df
            named = tempfile.mkdtemp(prefix="tamis-cut-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
