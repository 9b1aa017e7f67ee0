"""Gets this package to the executors, wherever the driver found it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of all executors, once for each application.

    Functions that run in tasks are pickled by the name of their module, which workers must be able to import. Without
    a context of its own (a remote session) nothing is done: there the package has to be installed.
    """
    context = getattr(spark, "_sc", None)
    if context is None or context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    # The driver serves this file to executors as long as it lives.
    folder = tempfile.mkdtemp(prefix="flowtide-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "flowtide_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
