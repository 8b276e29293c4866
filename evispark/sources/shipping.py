"""Sends this package to the executors, wherever the driver imported it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext

_sent: set[str] = set()


def ship(context: SparkContext) -> None:
    """Add the package to the Python path of all present and later executors, once per application."""
    if context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    if root.suffix != ".zip" and root.is_dir():
        path = Path(tempfile.mkdtemp(prefix="evispark-package-")) / "evispark.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(path))
    _sent.add(context.applicationId)
