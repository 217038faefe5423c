"""What several operators share: reading tables, cutting lineage, Arrow text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that Spark hands to a Python worker, about.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python workers in batches of some megabytes; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Hands memory that Arrow and the C library keep, though nothing uses it, back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim:
        trim(0)


def lean(rows):
    """``rows``, for mapInArrow, that gives memory back at its end: a Python worker outlives its tasks."""

    def freed(batches):
        yield from rows(batches)
        give_back()

    return freed


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate results that all machines of the session see.

    Only a local session without that setting gets a temporary folder; on a cluster a missing
    setting is an error, since a machine's own folder is not visible to the others.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder that the session names."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table in the shared folder and read again: for rows too large for ``cut``."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, *keep: str):
    """``docs`` with its other columns in one struct, out of the way of names that an operator adds, and what puts them back."""
    others = [c for c in docs.columns if c not in keep]
    slim = docs.select(*keep, F.struct(*others).alias("__aside")) if others else docs.select(*keep)

    def back(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c) if c in keep else F.col("__aside").getField(c).alias(c) for c in docs.columns))

    return slim, back


#: Samples by hash are taken on this many values, so that a share of any use is above none of them.
SHARES = 1 << 62


def in_share(hashed, share):
    """Whether a 64-bit hash falls into a share: a number from 0 to 1, or a Column of whole numbers up to SHARES."""
    return F.pmod(hashed, F.lit(SHARES)) < (F.lit(int(SHARES * share)) if isinstance(share, float) else share)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: these rows teach nothing."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and each text's start and end; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64, len(column) + 1 + column.offset)[column.offset :]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[ends[0] : ends[-1]], ends - ends[0]


def chunks(column: pa.Array, most_bytes: int = 2_000_000):
    """Slices (start, length) of a text column of about that many bytes, one row at least."""
    sizes = np.diff(utf8(column)[1])
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most_bytes:
            yield start, i - start
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes) - start
