"""Session helpers: tables, the shared folder, and shipping this package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package through Spark's own file server, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / "segmill_pkg.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"segmill/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *by: str, n: int | None = None) -> DataFrame:
    """df in parts of about ``rows`` rows by a hash of ``by``, however many rows there are, so that a part's work and memory don't grow with the table.

    At least a part for every core is made. ``df`` is counted for it, so it should be a table or little more; or ``n`` says how many there are.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-(df.count() if n is None else n) // rows))
    return df.repartition(parts, *by)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where one machine holds all, a temporary one is set if none is named; a cluster must name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jdir.get() if jdir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="segmill-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table into the shared folder, in a folder for each value of ``by`` if given, and read it back.

    This cuts lineage with files that survive lost executors, so that work which
    several later steps need runs once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/segmill/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._segmill_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote, when nothing reads it any more."""
    path = getattr(df, "_segmill_path", None)
    if path:
        jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings are ``values`` inside, and what they were behind."""
    kept = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
