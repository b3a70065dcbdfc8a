"""What the operators of this subpackage share: reading, lineage cuts, and byte-level array code."""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that array code takes at a time; one longer text makes a slice of its own, hashed in blocks of as many.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the shared checkpoint folder, so that nothing before it runs again.

    The folder is the session's own (spark.checkpoint.dir). Where that is unset, a temporary one is set on a local master, as
    in tests; on a cluster it is an error, since executors don't share such a folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return df.checkpoint(eager=True)


def swept(df: DataFrame) -> DataFrame:
    """As cut(); the driver then collects its garbage, since Spark keeps the shuffle files of what ran before until it does.

    Frames hold these too: those of Python that nobody has any more, in cycles with their methods, go first."""
    out = cut(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever its columns are called (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges whose texts hold about `limit` bytes at most; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse, as far as they were needed; sent to executors empty."""

    def __init__(self):
        self.held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __reduce__(self):
        return _Powers, ()


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64. Those of a slice are held, more are not."""
    if len(_POWERS.held[0]) >= n:
        return _POWERS.held[0][:n], _POWERS.held[1][:n]
    both = []
    for base in (_BASE, _INVERSE):
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        both.append(np.multiply.accumulate(step))
    if n <= SLICE_BYTES + 1:
        _POWERS.held = both
    return both[0][:n], both[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, with their byte spans and each text's first word.

    values: for each byte what it hashes as, 0 for a separator. Words don't run from one text into the next.
    Returns hashes, starts, ends, and offsets into them (one more than texts). What is longer than a slice is hashed in
    blocks that end at a separator, so that only one word longer than that takes more memory than its own.
    """
    out, at = [], 0
    while at < len(data) or not out:
        stop = min(len(data), at + SLICE_BYTES)
        while stop < len(data):
            gap = np.flatnonzero(values[data[at:stop]] == 0)
            if len(gap):
                stop = at + int(gap[-1]) + 1
                break
            stop = min(len(data), at + 2 * (stop - at))
        edge = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        hashes, starts, ends = _block_hashes(values[data[at:stop]], edge)
        out.append((hashes, starts + at, ends + at))
        at = stop if stop > at else len(data)
    hashes, starts, ends = out[0] if len(out) == 1 else (np.concatenate(x) for x in zip(*out, strict=True))
    return hashes, starts, ends, np.searchsorted(starts, offsets, "left")


def _block_hashes(v: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block of byte values: hashes, starts and ends of its words. edge: where texts begin in it."""
    is_word = v > 0
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    edge = edge[edge < len(v)]
    first[edge[is_word[edge]]] = True
    starts = np.flatnonzero(first)
    stop = is_word.copy()
    stop[:-1] &= ~is_word[1:] | first[1:]
    ends = np.flatnonzero(stop) + 1
    up, down = powers(len(v) + 1)
    total = np.empty(len(v) + 1, np.uint64)
    total[0] = 0
    np.multiply(v, up[: len(v)], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, ends


def released(batches):
    """The batches of a generator; at its end the worker, which lives on, gives back what it no longer holds."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass


def byte_values(separators: bytes, lower: bool = False) -> np.ndarray:
    """For word_hashes: bytes hash as themselves plus one, separators as 0, A-Z as a-z if lower."""
    v = np.arange(1, 257, dtype=np.uint16)
    if lower:
        v[65:91] = v[97:123]
    v[list(separators)] = 0
    return v


def share(spark: SparkSession, thing):
    """A broadcast of an object whose class executors need not have; opened() reads it there."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def opened(shared):
    return pickle.loads(shared.value)


def no_rows(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)


__all__ = ["DataFrame", "F", "SparkSession", "byte_values", "cut", "fresh", "mix", "no_rows", "opened", "parts", "powers", "released", "share", "slices", "swept", "table", "utf8", "word_hashes"]
