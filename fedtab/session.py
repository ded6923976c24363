"""Session and shared-storage helpers.

Library functions never create their own session; they take the caller's.
``shared_dir`` is the one place that decides where intermediate tables are
written: the cluster's ``spark.checkpoint.dir`` when it is set, and a fresh
local folder only when running in local mode without one (tests, bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, app: str = "fedtab", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's session."""
    master = master or os.environ.get("FEDTAB_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def _conf(spark: SparkSession, key: str) -> str | None:
    v = spark.sparkContext.getConf().get(key, None)
    if v:
        return v
    try:
        return spark.conf.get(key, None)
    except Exception:  # pragma: no cover - conf not visible in SQL conf
        return None


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Set only where it is unset and Spark runs in local mode (tests, bench); on a
    cluster an unset value is an error, never a machine-local folder.
    """
    root = _conf(spark, "spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = tempfile.mkdtemp(prefix="fedtab-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint root."""
    root = checkpoint_root(spark)
    return f"{root}/fedtab/{name}-{uuid.uuid4().hex[:12]}"


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df, name: str):
    """Write ``df`` once to the shared folder and read it back.

    Used where a plan reads the same derived table many times (a bias plan reads
    its cells about eight times): the derivation runs once, later reads are
    column-pruned parquet scans, and lineage is cut (a lost executor does not
    replay the derivation). The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    _remove_at_exit(spark, path)
    out = spark.read.parquet(path)
    out._written_at = path
    return out


def release(*tables) -> None:
    """Remove tables that ``materialize`` has written, once their successors are written; any other one stays."""
    for df in tables:
        path = getattr(df, "_written_at", None)
        if path:
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediate tables go when the application ends; until then its plans may read them again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (``addPyFile``), once per
    application, so grouped-map and pandas UDF bodies import on any executor.

    The zip is built on the driver and served by Spark's file server, which copies
    it to every executor; no executor reads a driver-local path.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="fedtab-pkg-"), "fedtab.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
