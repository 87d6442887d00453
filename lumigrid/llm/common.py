"""What the operators share: shared-folder tables, session helpers and Arrow plumbing.

Intermediate results that are read more than once are written as Parquet below the folder named by
``spark.checkpoint.dir`` (all executors see it); lineage is cut there, so a lost executor costs a re-read
and not a recomputation. Where the setting is absent, a session in local mode (tests, notebooks)
uses a private folder; on a cluster it is an error.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Documents a Python kernel handles at once, and the text bytes it aims at.
CHUNK_ROWS, CHUNK_BYTES = 2048, 2 << 20

_own: dict[str, str] = {}
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a private one only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lumigrid-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


def checkpoint_dir(spark: SparkSession) -> None:
    """Makes ``DataFrame.checkpoint`` usable where the session has no folder yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns a scan of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``table`` wrote and nothing will read again, and what Spark no longer needs of their making."""
    for df in tables:
        path = _paths.pop(id(df))
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps; on a small disk they would pile up until a JVM collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives back what this Python worker still holds from earlier tasks: workers live on between stages, idle ones with all they ever took.

    Tokenizers go with their stores of units; whoever needs one loads it again.
    """
    held = sys.modules.get(f"{__package__}.tokens")
    if held is not None:
        held.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


#: Bits of the filter that ``sift`` broadcasts: 131,072 rows of 64 bits whatever the input's size.
SIFT_BITS = 1 << 23


def sift(rows: DataFrame, ids: DataFrame, key: str = "doc_id", hits: bool = True) -> DataFrame:
    """``rows`` without most of those whose key isn't in ``ids`` (a table); a join on the key follows.

    With ``hits`` false the other rows, none of whose keys is in ``ids``.

    A hashed bitmap of fixed size goes to all tasks, so rows that can't join aren't shuffled. With very many ids it
    fills up and lets everything pass, which costs nothing but its effect.
    """
    place = lambda: F.pmod(F.xxhash64(key), F.lit(SIFT_BITS))
    word, bit = lambda: F.shiftright(place(), 6).cast("int"), lambda: (place() % 64).cast("int")
    one = F.expr("1L")
    marks = ids.select(word().alias("sift_word"), F.call_function("shiftleft", one, bit()).alias("mark")).groupBy("sift_word").agg(F.bit_or("mark").alias("sift_marks"))
    marks = F.broadcast(marks)
    hit = F.call_function("shiftright", marks["sift_marks"], bit()).bitwiseAND(F.lit(1)) == 1
    joined = rows.join(marks, word() == marks["sift_word"], "inner" if hits else "left")
    return joined.filter(hit if hits else ~F.coalesce(hit, F.lit(False))).select(*(rows[c] for c in rows.columns))


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` whose key isn't in ``ids`` (a table). Only rows that the bitmap of ``sift`` can't clear are shuffled."""
    asked = sift(rows, ids, key).join(ids.select(key), key, "left_anti").select(rows.columns)
    return sift(rows, ids, key, hits=False).unionByName(asked)


#: Rows of a small table that ``attach`` broadcasts, and the parts it deals rows to beyond that.
SMALL, SALTS = 100_000, 32


def attach(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``small`` (one row per key; nulls are a key): broadcast after a count of its rows, else joined
    with the rows of one key dealt to ``SALTS`` tasks, so a hot key is no task of its own. Each row of ``rows`` has its key there."""
    named = small.select(*(F.col(k).alias(f"attach_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    on = [rows[k].eqNullSafe(named[f"attach_{k}"]) for k in keys]
    more = [c for c in small.columns if c not in keys]
    if small.count() <= SMALL:
        return rows.join(F.broadcast(named), on).select(*(rows[c] for c in rows.columns), *more)
    salted = rows.withColumn("attach_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    dealt = named.withColumn("attach_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    on = [salted[k].eqNullSafe(dealt[f"attach_{k}"]) for k in keys]
    return salted.join(dealt, [*on, salted["attach_salt"] == dealt["attach_salt"]]).select(*(salted[c] for c in rows.columns), *more)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The key and the whole text (null: empty); other columns, clashing or not, stay out of the plan."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = CHUNK_ROWS, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of the batches, by rows and by bytes of ``column``; a single longer row stays whole."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(np.maximum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), 1).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, base + size, "right")), at + 1), at + rows, n)
            yield batch.slice(at, to - at)
            at = to


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, schema, strict=True)], schema=schema)
