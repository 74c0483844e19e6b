"""What the operators share: column names, checkpoints, byte and word arithmetic in numpy."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """``df`` reduced to the named columns under the operator's own names: nothing else can clash."""
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in wanted.items()))


def checkpoint_path(spark: SparkSession) -> str:
    """The cluster's shared folder as the session names it; a folder of our own only where none is set (tests)."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="factlake-checkpoint-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: later steps read files and not the lineage.

    Shuffle files go when the driver's JVM has collected what made them.  An operator of many rounds can't wait for a
    full heap, so the driver is asked to collect, every few seconds at most.
    """
    spark = df.sparkSession
    checkpoint_path(spark)
    out = df.checkpoint(eager=True)
    _collect(spark)
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the checkpoint folder: like :func:`cut`, for many small rows, as it is compressed."""
    spark = df.sparkSession
    path = f"{checkpoint_path(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _collect(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table that :func:`stored` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a step has written, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _collect(spark: SparkSession) -> None:
    now = time.monotonic()
    if now - _collected[0] > 3:
        _collected[0] = now
        gc.collect()
        spark.sparkContext._jvm.System.gc()


_collected = [0.0]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: For each of two independent hashes 256 odd-spread 64-bit values, one for each byte, and the base of the rolling sums, by rule.
_GOLDEN = 0x9E3779B97F4A7C15
BYTE_CODES = [mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * np.uint64(_GOLDEN)) for k in range(2)]
_BASES = [_GOLDEN | 1, 0xD6E8FEB86659FD93 | 1]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a hash's base and of its inverse modulo 2**64, kept for the next call."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[which] = (out[0], out[1])
    return have


def rolling(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums S with S[j] - S[i] the weighted sum of the codes of data[i:j]; see :func:`span_hash`."""
    p, _ = powers(len(data), which)
    s = np.empty(len(data) + 1, dtype=np.uint64)
    s[0] = 0
    np.cumsum(BYTE_CODES[which][data] * p[: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: equal bytes give equal hashes wherever they stand."""
    _, inverse = powers(len(s), which)
    return mix((s[end] - s[start]) * inverse[start] + (end - start).astype(np.uint64))


_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text whose words are cut out at a time.
_SLICE = 1 << 22


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word by itself, A-Z lower-cased first if ``lower``.

    Words are hashed by xxh3, as sums of powers modulo 2**64 are equal for some different words of a thousand letters.
    """
    out, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + _SLICE) if len(text) - at > _SLICE else None
        end = gap.start() if gap else len(text)
        part = text[at:end]
        # bytes are split at just those six separators, and only A-Z have a lower case
        words = (part.lower() if lower else part).split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it has fewer words; none if empty."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    k_here = min(k, n)
    h = np.full(n - k_here + 1, k_here, dtype=np.uint64)
    for i in range(k_here):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : n - k_here + 1 + i])
    return np.unique(h)
