"""Sources: picture listings, recognised words, manifests, ordered trees, the result cache."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes as C
from ..functions import text as X
from ..functions.text import natural_key
from ..operators.tree import first_of, parents
from .workbook import read_workbooks

WORDS = T.StructType(
    [
        T.StructField("image", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("block_num", "par_num", "line_num")], T.StructField("text", T.StringType()),
        T.StructField("conf", T.DoubleType()), *[T.StructField(c, T.IntegerType()) for c in ("left", "top", "width", "height")],
    ]
)
NODES = T.StructType(
    [
        T.StructField("node_id", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()),
        T.StructField("raw_properties", T.MapType(T.StringType(), T.StringType())), T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)


def images(spark: SparkSession, *folders: str, extensions: Sequence[str] = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")) -> DataFrame:
    """(S1, S2) (path, name, length, modificationTime), each file once, in natural order; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders)).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    return df.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*extensions)).dropDuplicates(["path"]).withColumn("name", name).orderBy(natural_key(F.col("name")), "path")


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a contract table: missing ones are null, others are left out."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def words(spark: SparkSession, path: str, format: str = "parquet", scale: float = 1.0) -> DataFrame:
    """(S3-S7) The table of recognised words, coordinates brought back to the picture's scale."""
    df = with_schema(spark.read.format(format).option("header", True).load(path), WORDS)
    return df.select(*[F.bround(F.col(c) / scale).cast("int").alias(c) if c in ("left", "top", "width", "height") else F.col(c) for c in df.columns])


def aliased(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """(S22) Columns under the first of their names that the table has and that is neither null nor empty."""
    filled = lambda n: F.when(F.col(n).cast("string") != "", F.col(n).cast("string"))
    pick = lambda names: F.coalesce(*[filled(n) for n in names if n in df.columns], F.lit(None).cast("string"))
    return df.select(*[pick(names).alias(c) for c, names in aliases.items()])


#: Names under which recognised rows bring their fields.
RECOGNISED = {
    "raw_text": ("raw_text", "text", "annotation", "ocr_text"), "series_code": ("series_code",), "tolerance_value": ("tolerance_value",), "tolerance_lower": ("tolerance_lower",),
    "tolerance_upper": ("tolerance_upper",), "references": ("datum_raw", "references"), "name": ("name",), "kind": ("catia_type",), "multiplicity": ("multiplicity",),
    "symbol": ("symbol_label", "symbol"), "symbol_character": ("symbol_character",),
}


def recognised(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(S22) Rows of recognised text under one set of columns: what a row does not bring is read from its text (code, multiplicity,
    tolerance), and reference letters from text and references together. Rows stay as many as they are; `key` comes first."""
    own = {f"_{k}": (k,) for k in key}
    s = aliased(df, RECOGNISED | own)
    clean = lambda c: X.clean_space(F.coalesce(F.col(c), F.lit("")))
    s = s.withColumn("raw_text", clean("raw_text")).withColumn("series_code", F.coalesce(F.nullif(clean("series_code"), F.lit("")), X.first_code(F.col("raw_text"))))
    both = C.unique_texts(F.array("raw_text", clean("references")))
    refs = F.upper(F.array_join(both, " | "))
    flags = X.datum_flags(refs)
    given = F.floor(X.number(F.col("multiplicity"))).cast("int")
    back = [F.col(f"_{k}").cast(df.schema[k].dataType).alias(k) for k in key]
    return s.select(
        *back, "raw_text", "series_code", F.coalesce(F.when(given >= 1, given), X.multiplicity(F.col("raw_text"))).alias("multiplicity"), clean("symbol").alias("symbol"), clean("symbol_character").alias("symbol_character"),
        F.coalesce(X.number(F.col("tolerance_value")), X.tolerance(F.col("raw_text"), F.col("series_code"))).alias("tolerance_value"), X.number(F.col("tolerance_lower")).alias("tolerance_lower"),
        X.number(F.col("tolerance_upper")).alias("tolerance_upper"), refs.alias("references"), *[flags[c].alias(f"datum_{c.lower()}") for c in "ABCDE"],
        clean("name").alias("name"), F.coalesce(F.nullif(clean("kind"), F.lit("")), F.lit("OCR")).alias("kind"), F.lit("OCR").alias("read_status"),
    )


def manifest_items(spark: SparkSession, path: str, array: str, code: str, order: str) -> DataFrame:
    """(S19) The array of a JSON document as rows, the first row of each code."""
    rows = spark.read.json(path, multiLine=True).select(F.explode(array).alias("x")).select("x.*")
    return first_of(rows.where(F.coalesce(F.col(code), F.lit("")) != ""), F.upper(F.col(code)), order)


def with_parents(rows: DataFrame, file: str = "file", line: str = "line", levels: int = 64) -> DataFrame:
    """(S18, J2) Nodes of ordered lines (text, level, and where there is one node_id): file, line, node_id, parent_id, level, text,
    hierarchy_status. A level that is no whole number is 0, a line without id is named by its place, and a line's parent is
    the nearest line before it in its file with a lesser level. Levels of `levels` or more are an error."""
    name = F.concat(F.lit("X"), F.lpad(F.col(line).cast("string"), 5, "0"))
    own = F.col("node_id").cast("string") if "node_id" in rows.columns else F.lit(None).cast("string")
    level = F.coalesce(F.col("level").try_cast("double").try_cast("int"), F.lit(0))
    df = rows.select(file, line, F.coalesce(F.nullif(own, F.lit("")), name).alias("node_id"), level.alias("level"), X.clean_space(F.coalesce("text", F.lit(""))).alias("text"))
    return parents(df, file, line, "level", levels, "node_id").select(file, line, "node_id", F.coalesce("parent_name", F.lit("")).alias("parent_id"), "level", "text", "hierarchy_status")


def workbook_trees(spark: SparkSession, path: str, sheet: str | None = None, levels: int = 64) -> tuple[DataFrame, DataFrame]:
    """(S18) (nodes of all workbooks of a folder, what could not be read: file, sheet, line, error). Each file's header is the
    row that names text and level; a file without one gives an error and no nodes."""
    options = {"required": "text,level"} | ({"sheet": sheet} if sheet else {})
    rows = read_workbooks(spark, path, "file string, sheet string, line long, text string, level string, node_id string, error string", **options)
    return with_parents(rows.where("line IS NOT NULL"), levels=levels), rows.where("error IS NOT NULL").select("file", "sheet", "line", "error")


def ordered_tree(spark: SparkSession, path: str, levels: int = 64) -> DataFrame:
    """(S18) The same of CSV files of (line, text, level), a tree each."""
    df = spark.read.csv(path, header=True)
    if missing := {"line", "text", "level"} - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return with_parents(df.select("*", F.input_file_name().alias("file")).withColumn("line", F.col("line").cast("long")), levels=levels)


def variant(x: Column) -> Column:
    """(S10) The threshold of `raw`, `binary` (128), `code` (160) or `code_n`, n up to 255; anything else is an error."""
    n = F.regexp_extract(x, "^code_([0-9]{1,3})$", 1).try_cast("int")
    return F.when(x == "raw", F.lit(None).cast("int")).when(x == "binary", 128).when(x == "code", 160).when(n.between(0, 255), n).otherwise(F.raise_error(F.concat(F.lit("unknown variant "), x)).cast("int"))


def signature(df: DataFrame, columns: Sequence[str], version: str = "1") -> str:
    """(S21) SHA-256 over the sorted rows' digests and a version: equal for equal inputs in any order."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    # Digests are added as numbers, so no list of all rows comes together anywhere.
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(5)]
    values = df.agg(F.count(F.lit(1)), *parts).first()
    import hashlib

    return hashlib.sha256(repr((version, *map(str, values))).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """(S20) The table made for a signature, made once."""
    path = f"{folder.rstrip('/')}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)
