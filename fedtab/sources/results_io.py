"""Result tables and round state on shared storage (#2, #4, #5, #6)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_results_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """#4: CSV with a header; partitioned by e.g. alpha instead of one file name per alpha."""
    w = df.write.mode("overwrite").option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_results_csv(spark: SparkSession, path: str, schema: T.StructType,
                     index_col: str | None = "_idx") -> DataFrame:
    """#2: read with a declared schema (no inference). Files written with a leading
    unnamed index column get it as ``index_col``, which is dropped."""
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
          .option("mode", "FAILFAST").csv(path))
    return df.drop(index_col) if index_col and index_col in df.columns else df


def write_round_state(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("method", "round")) -> None:
    """#5: state partitioned by run and round; dynamic partition overwrite makes a
    re-run of one round idempotent without touching the others."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def read_round_state(spark: SparkSession, path: str, **partition_values) -> DataFrame:
    """#6: read the state back; equality filters on partition columns are pruned."""
    df = spark.read.parquet(path)
    for k, v in partition_values.items():
        df = df.filter(df[k] == v)
    return df


STATE_PARTS = ("cells", "metrics", "communication", "bias", "config")


def write_checkpoint(parts: dict[str, DataFrame], path: str, partition_by: tuple[str, ...] = ("method", "alpha", "round")) -> str:
    """#5: a full round state as one commit. ``parts`` maps names (``STATE_PARTS``) to tables that have the partition
    columns: parameter state, metric, communication and bias histories, and the configuration with its seed.

    All parts go to folders of a new version; then one manifest file, renamed into place, makes them visible together.
    A writer that fails before leaves folders that no reader looks at. A round that a later version holds replaces
    that round's earlier rows in every part and leaves all other rounds alone. Returns the version.
    """
    spark = next(iter(parts.values())).sparkSession
    committed = checkpoint_versions(spark, path)
    number = int(committed[-1].split("-")[0]) + 1 if committed else 1
    version = f"{number:012d}-{uuid.uuid4().hex[:8]}"
    for name in parts:
        parts[name].write.partitionBy(*partition_by).parquet(f"{path}/{name}/_version={version}")
    _commit(spark, f"{path}/_manifest", number, [*committed, version], sorted(parts), list(partition_by))
    return version


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def _commit(spark: SparkSession, folder: str, number: int, versions: list[str], parts: list[str], keys: list[str]) -> None:
    """Write manifest ``number`` beside its place and rename it there; two writers of one number cannot both succeed."""
    fs, _, jvm = _hadoop(spark, folder)
    place, beside = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (f"{number:012d}.json", f".{uuid.uuid4().hex}.tmp"))
    out = fs.create(beside, False)
    out.write(json.dumps({"versions": versions, "parts": parts, "keys": keys}).encode())
    out.close()
    if fs.exists(place) or not fs.rename(beside, place):
        fs.delete(beside, False)
        raise RuntimeError(f"another writer has committed {place.toString()}; write this round again")


def _manifest(spark: SparkSession, path: str) -> dict:
    """The last manifest: names of its versions in order, parts and keys. Its size follows the number of commits."""
    fs, at, jvm = _hadoop(spark, f"{path}/_manifest")
    if not fs.exists(at):
        return {"versions": [], "parts": [], "keys": []}
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    last = [n for n in names if n.endswith(".json")][-1:]
    if not last:
        return {"versions": [], "parts": [], "keys": []}
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/{last[0]}"))
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def checkpoint_versions(spark: SparkSession, path: str) -> list[str]:
    """Committed versions, oldest first."""
    return _manifest(spark, path)["versions"]


def read_checkpoint(spark: SparkSession, path: str, **partition_values) -> dict[str, DataFrame]:
    """#6: the parts of a checkpoint as of its last commit; a checkpoint without a commit raises ``FileNotFoundError``.

    Of every round the newest committed version counts, found from the folders' names alone. Equality filters on
    partition columns are pruned in each part.
    """
    manifest = _manifest(spark, path)
    if not manifest["versions"]:
        raise FileNotFoundError(f"no committed checkpoint at {path}")
    keys, parts = manifest["keys"], {}
    for name in manifest["parts"]:
        df = spark.read.option("basePath", f"{path}/{name}").parquet(
            *[f"{path}/{name}/_version={v}" for v in manifest["versions"]])
        for k, v in partition_values.items():
            df = df.filter(df[k] == v)
        parts[name] = df
    # A round of a version replaces the whole round, also in parts that have fewer rows now.
    rounds = None
    for df in parts.values():
        own = df.select(*keys, "_version").distinct()
        rounds = own if rounds is None else rounds.union(own)
    newest = rounds.groupBy(*keys).agg(F.max("_version").alias("_version"))
    return {name: df.join(newest, [*keys, "_version"], "left_semi").drop("_version") for name, df in parts.items()}
