"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "shirabe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this package's defaults and the package on its workers; ``conf`` (dots as ``__``) overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (_DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of ``spark``, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="shirabe-")) / "shirabe_package.zip"
        with zipfile.ZipFile(target, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on a single machine (tests) a local folder is made and used; on a
    cluster a missing setting is an error, as no local folder can be read by all executors.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shirabe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is dropped when the session stops."""
    path = os.path.join(shared_dir(spark), f"shirabe-{name}-{uuid.uuid4().hex}")
    if not _written:
        atexit.register(_drop_all)
    if not hasattr(spark, "_shirabe_stop"):
        spark._shirabe_stop = spark.stop

        def stop() -> None:
            _drop_all(spark)
            spark._shirabe_stop()

        spark.stop = stop
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the input only once, and survives the
    loss of executors.  The files are dropped by ``discard``, or else when the session stops.
    ``lean`` spares disk: the files are packed closer, and the shuffles that made them are dropped
    at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if lean:
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path, compression="zstd")
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shirabe_path = path
    return out


def discard(df: DataFrame) -> None:
    """Drop the files of a table that ``materialize`` made, once nothing reads it any more."""
    path = getattr(df, "_shirabe_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [w for w in _written if w[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all(only: SparkSession | None = None) -> None:
    for spark, path in list(_written):
        if only is None or spark is only:
            try:
                _delete(spark, path)
            except Exception:  # the context may be gone already
                continue
            _written.remove((spark, path))
