"""Make the package importable by Python workers.

Arrow UDFs are pickled by reference, so executors must be able to import
``tessera``.  On a cluster the usual route is ``--py-files``; when the
package is not shipped that way, it is zipped once per SparkContext and
added with ``addPyFile`` (Spark distributes the file to every executor).
"""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

_lock = threading.Lock()
_done: set = set()


def ensure(spark=None) -> None:
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext, rely on artifacts added by the user
        return
    key = sc.applicationId
    if key in _done:
        return
    with _lock:
        if key in _done:
            return
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        if os.environ.get("TESSERA_NO_SHIP") != "1":
            out_dir = tempfile.mkdtemp(prefix="tessera-pyfiles-")
            path = os.path.join(out_dir, "tessera.zip")
            root = os.path.dirname(pkg_dir)
            with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
                for base, dirs, files in os.walk(pkg_dir):
                    dirs[:] = [d for d in dirs if d != "__pycache__"]
                    for f in files:
                        if f.endswith(".py"):
                            full = os.path.join(base, f)
                            z.write(full, os.path.relpath(full, root))
            sc.addPyFile(path)
        _done.add(key)
