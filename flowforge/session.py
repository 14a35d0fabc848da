"""Session helpers: building a local session for tests/bench and finding the
shared scratch folder that lineage cuts and round-trip writes go to.

On a cluster the scratch folder is whatever ``spark.checkpoint.dir`` names
(a shared filesystem every executor can read).  Only when that setting is
absent -- local runs and tests -- do we create a private folder.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "flowforge") -> SparkSession:
    """A local session configured the way the tests and the bench expect."""
    cores = str(cores)
    parts = shuffle_partitions or (8 if cores == "*" else max(int(cores), 1))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    Reads ``spark.checkpoint.dir`` from the session; a private folder is made
    only when nothing is configured (local runs and tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="flowforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``flowforge`` importable in Python workers (mapInPandas, the
    capture data source): a zip of the package is written to the shared
    checkpoint folder (any Hadoop file system) and added with ``addPyFile``.
    Done once per context."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import io
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pyfiles/flowforge-{uuid.uuid4().hex[:8]}.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(target)
    fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(hpath, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)


#: Scratch folders made in each open scope, the innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder.  Made within a
    ``scratch_scope``, it is deleted when that ends."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own on any Hadoop file system."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Owns the scratch folders made within: what needs them must be written or
    read before the scope ends.  Shuffle files of finished steps go too; Spark
    keeps them until the driver has collected its garbage."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove_folder(spark, path)
        release_shuffles(spark)


def release_shuffles(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written_in_scope(spark: SparkSession, name: str, make) -> DataFrame:
    """The rows of ``make()`` written as Parquet under the shared folder; scratch
    folders that making them took are deleted."""
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
        del df
    return spark.read.schema(schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and return a frame
    that reads the materialised copy.  Never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A table of at most so many rows is sent to every task that looks rows up in it.
LOOKUP_ROWS = 50_000


def lookup(df: DataFrame) -> DataFrame:
    """``df`` (one row per group) materialised for a join with all rows.  Of few
    rows it is broadcast: Spark only knows its estimated size, and would deal all
    rows by their group first, however few groups there are."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= LOOKUP_ROWS else df


def qualify(spark: SparkSession, path: str) -> str:
    """Fully qualified URI of ``path`` as file listings report it
    (e.g. ``/data/x`` -> ``file:/data/x``)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hpath).toString().rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver-provided parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
