"""Shared plumbing: intermediate tables in the cluster's shared folder and small column helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that separates words, as a regular-expression class body and as plain characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may fall back to a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, so a lost executor costs
    no recomputation, and the next join sees real sizes and no inherited partitioning (skew can be split). The shuffle files of
    the job have no further use, so Spark removes them at its end and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that keep wrote, before the folder is cleared; of other tables nothing. What still reads them lazily would fail."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/evidentia/{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of written tables
_SCOPES: list[list[str]] = []  # of the caller, the innermost last


def written_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """keep(make()), without the tables that were written on the way to it."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        df = make()
    finally:
        _SCOPES.pop()
    out = keep(df)
    for path in made:
        _delete(spark, path)
    return out


def fresh(name: str, columns: list[str]) -> str:
    """A column name that no column has (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def ship(spark: SparkSession) -> None:
    """Give the workers this package where they would not find it: neither installed nor on their path."""
    root = Path(__file__).resolve().parents[2]
    if Path.cwd() == root or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "site-packages" in root.parts:
        return
    if getattr(spark.sparkContext, "evidentia_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "evidentia_llm.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "evidentia").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext.evidentia_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
