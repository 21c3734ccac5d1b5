"""What a job on several machines needs: a folder that all of them see, and this package on every executor."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, else the context's, else one beside the warehouse, which is then set."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not context.getCheckpointDir():
        known = known or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-checkpoints/{context.applicationId}"
        context.setCheckpointDir(known)
    return known.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application."""
    context = spark.sparkContext
    if getattr(context, "_tabweave_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory()  # removed when the context's Python object goes
    target = pathlib.Path(folder.name) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    context._tabweave_shipped = folder
