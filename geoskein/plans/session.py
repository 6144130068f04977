"""Sessions, table loading and the cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings for a session of our own; a cluster's session brings its own.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("geoskein")
    return builder.config(map={**LOCAL_CONF, **conf}).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application; operators call it before they make a Python stage."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="geoskein-")) / "geoskein.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    sc = spark.sparkContext
    jdir = sc._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "geoskein-checkpoints")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder: later uses read them again instead of computing them,
    and survive the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def once(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; filters on the columns stay above them, where the planner would write their expressions out again
    for each use, down to code that is too long to compile.  Costs no disk, unlike ``cut``."""
    return df.withColumns({c: F.when(F.monotonically_increasing_id() >= 0, F.col(c)) for c in columns})
