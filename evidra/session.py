"""Session helpers: a local session for tests and benches, and shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}
_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine, with UTC times and adaptive execution."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evidra")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's code to the executors, once for each application."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="evidra-code-")) / "evidra.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, os.path.relpath(file, root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(application)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Where the setting is missing, a session on one machine (`local[...]`) gets a temporary folder, which is also made
    the checkpoint folder; elsewhere that is an error, as executors could not see such a folder.
    """
    found = spark.conf.get(_SETTING, None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    if context.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="evidra-")
        atexit.register(shutil.rmtree, folder, True)
        _own[context.applicationId] = f"file://{folder}"
        context.setCheckpointDir(_own[context.applicationId])
    return _own[context.applicationId]
