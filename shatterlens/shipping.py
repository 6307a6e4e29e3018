"""The package's code for Python workers that cannot import it."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from shatterlens.scratch import shared_root

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's workers this package, once; it lies in the shared folder, or on the driver if that is no path here."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    root = shared_root(spark).removeprefix("file://")
    folder = Path(root if root.startswith("/") else spark.sparkContext._temp_dir) / f"shatterlens-code-{app}"
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / "shatterlens.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
