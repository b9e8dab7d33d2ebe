"""Sinks. Tables go out as folders of part files, so they scale; single files are for small reports only."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rendered

MOST_REPORT = 100_000  # rows of a single-file report


def _small(df: DataFrame) -> DataFrame:
    if df.limit(MOST_REPORT + 1).count() > MOST_REPORT:
        raise ValueError(f"a report of more than {MOST_REPORT} rows; write a table instead")
    return df


def sheet(df: DataFrame) -> DataFrame:
    """(F13, K7) Every cell as text."""
    return df.select(*[rendered(F.col(n), t).alias(n) for n, t in df.dtypes])


def csv_report(df: DataFrame, path: str) -> None:
    """(K1) One CSV file that begins with a byte-order mark."""
    _small(df).toPandas().to_csv(path, index=False, encoding="utf-8-sig")


def json_report(df: DataFrame, path: str) -> None:
    """(K2) One JSON array."""
    rows = [r[0] for r in _small(df).select(F.to_json(F.struct(*df.columns))).collect()]
    with open(path, "w", encoding="utf-8") as f:
        f.write("[" + ",\n".join(rows) + "]")


def tables(frames: dict[str, DataFrame], folder: str, format: str = "parquet") -> dict[str, str]:
    """(K4) One folder per table; an existing folder is left alone and a dated one is written beside it (K4)."""
    out = {}
    for name, df in frames.items():
        path = f"{folder.rstrip('/')}/{name}"
        try:
            df.write.format(format).mode("errorifexists").option("header", True).save(path)
        except Exception as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            path = f"{path}_{time.strftime('%Y%m%d_%H%M%S')}_{time.monotonic_ns() % 10**6}"
            df.write.format(format).option("header", True).save(path)
        out[name] = path
    return out


def document(df: DataFrame, order: str, array: str, count: str, head: dict[str, str] | None = None) -> DataFrame:
    """(K9, K16) One JSON document: the head's members, how many rows there are, and the rows in order under `array`."""
    rows = _small(df).agg(F.sort_array(F.collect_list(F.struct(order, F.struct(*df.columns).alias("row")))).alias("r"))
    members = [F.lit(v).alias(k) for k, v in (head or {}).items()]
    return rows.select(F.to_json(F.struct(*members, F.size("r").alias(count), F.transform("r", lambda x: x["row"]).alias(array))).alias("document"))


def code_manifest(nodes: DataFrame, name: str, order: str = "order", code: str = "series_code", carry: Sequence[str] = ("ref_parent", "functional_group", "tree_path")) -> DataFrame:
    """(K9) The document of the codes that a tree holds, in order; what S19 reads."""
    held = nodes.where(F.coalesce(F.col(code), F.lit("")) != "").select(F.col(order).alias("order"), F.col(code).alias("series_code"), *carry)
    return document(held, "order", "series", "series_count", {"document": name, "method": "direct_tree"})


def document_file(doc: DataFrame, path: str) -> None:
    """(K9, K16) The document as a folder with one text file."""
    doc.coalesce(1).write.mode("overwrite").text(path)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """(K5) Rows of all, columns of any."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def diagnostics(frames: dict[str, DataFrame]) -> DataFrame:
    """(K8) One JSON document of several small tables."""
    out = None
    for name, df in frames.items():
        one = _small(df).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("j")).select(F.concat(F.lit(f'"{name}":'), "j").alias("part"), F.lit(name).alias("name"))
        out = one if out is None else out.union(one)
    return out.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "part"))), lambda s: s["part"]), ","), F.lit("}")).alias("document"))
