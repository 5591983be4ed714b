"""Session factory and lineage cutting."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # files of checkpoints that nothing refers to any more are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, app: str = "weblattice", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; conf overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    share_package(spark)
    return spark


class NoSharedFolder(RuntimeError):
    """A cluster that names no folder for checkpoints."""


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of checkpoints.

    A cluster names it in ``spark.checkpoint.dir``; only on a local master, where driver and executors are one process, a temporary
    folder takes its place. Elsewhere its lack is an error, as other machines could not read such a folder.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise NoSharedFolder("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weblattice-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage.

    The files outlive any executor, so a lost one costs only its running tasks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def share_package(spark: SparkSession) -> None:
    """Lets Python workers that see this folder import the package, wherever the session was started.

    A cluster without a shared folder gets the package by ``--py-files``, as any.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
