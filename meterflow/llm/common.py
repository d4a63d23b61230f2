"""Shared helpers: reading tables, cutting lineage in the shared folder, text buffers for numpy."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of bytes that are neither a space nor one of the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: str | None = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; Python workers started from now on find this package where the driver found it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all tasks run in one process (tests), a temporary one."""
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="meterflow-")
        spark.sparkContext.setCheckpointDir(_own_folder)
    return _own_folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and executors may be lost."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that cut() returned, once nothing to come reads it."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that no variable holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def doc_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns _d, _h that tell documents apart; rows that repeat with one id and one text share them."""
    return [doc_id.cast("long").alias("_d"), F.xxhash64(text).alias("_h")]


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["_d"].eqNullSafe(b["_d"]) & (a["_h"] == b["_h"])


def buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of an Arrow string array; a null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if hasattr(arr, "combine_chunks"):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data, off - off[0]


def pieces(offsets: np.ndarray, most: int):
    """Ranges (i, j) of documents whose bytes together stay within most, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, of new memory."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts, and n+1 offsets of each text's first word."""
    word = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # words never cross texts
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte string [start, end)."""
    import xxhash

    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    size = ends - starts
    h = mix((size.astype(np.uint64) + np.uint64(1)) * _K)
    at = np.arange(len(starts))
    k = 0
    while len(at) and k < 4096:
        left = size[at] - k
        chunk = np.ascontiguousarray(eight[starts[at] + k]).view("<u8")[:, 0] & _MASKS[np.minimum(left, 8)]
        h[at] = mix((h[at] ^ chunk) * _K)
        k += 8
        at = at[left > 8]
    for i in at:
        h[i] ^= np.uint64(xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].tobytes()))
    return h


def rolling(h: np.ndarray, k: int, step: int = 1) -> np.ndarray:
    """Hash of each k consecutive values, step apart, before finishing by mix(): len(h) - (k-1)*step of them."""
    n = len(h) - (k - 1) * step
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _K
        out += h[j * step : j * step + n]
    return out


def dealt(spark: SparkSession, docs: DataFrame, each: int = 16 << 20) -> int:
    """Buckets for an exchange: so many that each gets about `each` bytes of text, the session's partitions at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // each))
