"""Writers: JSON, partitioned results, the graph, upserts, appends without doubles, manifests and archives.

Tables are written through Spark's committers: a failed write leaves the old output. Signing and packing run on the driver
over files that were already written, one file at a time.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """Line-delimited JSON, one folder per value of ``by`` when given."""
    writer = (df.repartition(by) if by else df).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices, and edges in one folder per relationship."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.repartition("relationship").write.mode("overwrite").partitionBy("relationship").parquet(f"{path}/edges")


def upsert(new: DataFrame, path: str, key: str, how: str = "replace") -> None:
    """Merge rows by key into a parquet table and swap it in: ``replace`` all columns, ``fill`` nulls only, or ``skip`` known keys.

    Repeated keys among the new rows count once (the greatest row).
    """
    spark = new.sparkSession
    restore(spark, path)
    one = new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("n")).select(key, "n.*")
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        one.write.mode("overwrite").parquet(path)
        return
    if how == "skip":
        merged = old.unionByName(one.join(old.select(key), key, "left_anti"), allowMissingColumns=True)
    elif how == "replace":
        merged = old.join(one.select(key), key, "left_anti").unionByName(one, allowMissingColumns=True)
    else:
        columns = [c for c in dict.fromkeys([*old.columns, *one.columns]) if c != key]
        pick = lambda c: F.coalesce(*(F.col(f"{side}.{c}") for side, cols in (("o", old.columns), ("n", one.columns)) if c in cols)).alias(c)
        merged = old.alias("o").join(one.alias("n"), key, "full").select(key, *(pick(c) for c in columns))
    _swap(merged, path)


def _swap(df: DataFrame, path: str) -> None:
    """Write beside the table, move the old one aside, the new one in and then delete the old one.

    The table is whole under ``path`` or, after a crash between the two renames, under ``path__old``, from where ``restore`` brings it back.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}__new")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    here, fresh, aside = hadoop.Path(path), hadoop.Path(f"{path}__new"), hadoop.Path(f"{path}__old")
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(aside, True)
    files.rename(here, aside)
    files.rename(fresh, here)
    files.delete(aside, True)


def restore(spark: SparkSession, path: str) -> None:
    """Bring back a table that a crash left moved aside."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    here, aside = hadoop.Path(path), hadoop.Path(f"{path}__old")
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(here) and files.exists(aside):
        files.rename(aside, here)


def export_case(sections: dict[str, DataFrame], path: str) -> None:
    """One folder of CSV and one of JSON per section of a case."""
    for name, df in sections.items():
        write_csv(df, f"{path}/{name}/csv")
        write_json(df, f"{path}/{name}/json")


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table does not have."""
    one = df.dropDuplicates([key])
    try:
        known = df.sparkSession.read.parquet(path).select(key)
        one = one.join(known, key, "left_anti")
    except AnalysisException:
        pass
    one.write.mode("append").parquet(path)


def write_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``name, n_bytes, sha256`` of the files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """``name, state`` of every file: same, changed, missing or extra."""
    now = manifest(spark, path).select("name", F.col("sha256").alias("now"))
    both = expected.select("name", F.col("sha256").alias("then")).join(now, "name", "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "extra").when(F.col("now") == F.col("then"), "same").otherwise("changed")
    return both.select("name", state.alias("state"))


def sign(entries: list[dict], secret: bytes) -> str:
    """HMAC-SHA-256 over the sorted entries of a manifest."""
    return hmac.new(secret, json.dumps(sorted(entries, key=lambda e: e["name"]), sort_keys=True).encode(), hashlib.sha256).hexdigest()


def pack(folder: str, target: str, secret: bytes) -> dict:
    """A tar archive of a local folder with a signed manifest; returns the manifest."""
    root = Path(folder)
    entries = [{"name": str(p.relative_to(root)), "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in sorted(root.rglob("*")) if p.is_file()]
    signed = {"files": entries, "signature": sign(entries, secret)}
    (root / "manifest.json").write_text(json.dumps(signed, indent=1))
    with tarfile.open(target, "w:gz") as tar:
        tar.add(root, arcname=root.name)
    return signed
