"""Session settings used by tests, the bench and jobs started from this repository."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "leafscore", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the operators expect (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, unless it is installed.

    Functions that run in Python workers are pickled by module name, so the workers must be able to import the package
    whatever their working directory is.
    """
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if context.applicationId in _SHIPPED or "site-packages" in package.parts:
        return
    archive = os.path.join(context._temp_dir, f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for written intermediate tables, visible to every executor.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one process, may use a temporary folder instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="leafscore-")
    return os.path.join(root, f"{label}-{uuid.uuid4().hex[:12]}")
