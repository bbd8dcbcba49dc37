"""A PySpark engine for retrieval-and-answer pipelines and for preparing training corpora."""

from __future__ import annotations

import os
from pathlib import Path


def let_workers_import(spark) -> None:
    """Put this package's parent on the path of Python workers that start from now on, wherever the driver was started.
    A cluster without a shared file system still needs the package installed or sent by --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
