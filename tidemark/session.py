"""Session set-up: settings the engine expects, and its code on the executors."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
_shipped: set[str] = set()


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; settings override them (dots as underscores are not translated)."""
    builder = SparkSession.builder.appName("tidemark").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application, so Python workers import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local
    master, whose executors are the driver, gets a temporary one where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder and read from there."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
