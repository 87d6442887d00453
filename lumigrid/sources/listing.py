"""Which files make a recording, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import naming

FORMATS = {"tif": "tif", "tiff": "tif", "dcimg": "dcimg", "sifx": "sifx", "nd2": "nd2", "h5": "h5"}


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, name, format, size_bytes, mtime): metadata only, contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    kinds = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select("path", name.alias("name"), kinds[suffix].alias("format"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")).filter("format is not null")


def recording_files(files: DataFrame, input_format: str = "auto", order: str = "natural") -> DataFrame:
    """The files of one format in reading order: adds file_idx. ``auto`` needs exactly one format; orders: natural, name, mtime (ties: natural)."""
    if order not in ("natural", "name", "mtime"):
        raise ValueError(f"unknown order: {order}")
    found = sorted(r["format"] for r in files.select("format").distinct().collect())
    if input_format == "auto":
        if len(found) != 1:
            raise ValueError(f"one format is needed, found {found}") if found else FileNotFoundError("no recording files")
        input_format = found[0]
    elif FORMATS.get(input_format, input_format) not in found:
        raise FileNotFoundError(f"no {input_format} files")
    natural = naming.natural_key(F.col("name"))
    by = {"natural": [natural, F.col("name")], "name": [F.col("name")], "mtime": [F.col("mtime"), natural]}[order]
    chosen = files.filter(F.col("format") == FORMATS.get(input_format, input_format))
    return chosen.withColumn("file_idx", (F.row_number().over(Window.orderBy(*by)) - 1).cast("int"))  # a row per file


def experiment_stem(files: DataFrame, fallback: str | None = None) -> str:
    """The first file's stem, else the fallback, else ``output``."""
    row = files.agg(F.min_by("name", "file_idx").alias("n")).first()
    stem = row["n"].rsplit(".", 1)[0] if row and row["n"] else ""
    return stem or fallback or "output"
