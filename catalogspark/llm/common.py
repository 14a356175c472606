"""Shared pieces: tables, per-worker state and vectorised words of whole texts."""

import ctypes
import gc
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.session import broadcast_if_small, row_bytes

# Texts are handled in pieces of about this many bytes, so the arrays of one piece stay small.
PIECE_BYTES = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its measured bytes are within the library's bound."""
    size = df.select(row_bytes(*[F.col(f"`{c}`") for c in df.columns])).first()[0]
    return broadcast_if_small(df, size)


def lower_ascii(text):
    """A-Z of a text column in lower case, other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fold_of(doc_id: str, parts: int):
    """Fold of a document: crc32 of its id as text, modulo ``parts`` (no id: the empty text)."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(parts))


def worker_state(name: str, make):
    """A value made once per Python worker and kept for its later tasks."""
    home = sys.modules.setdefault("_catalogspark_worker", types.ModuleType("_catalogspark_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


# Rows of an Arrow batch while they are whole texts; Spark's own default is for narrow rows.
TEXT_ROWS = 1000
_BATCH_ROWS, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; where the session has Spark's default, batches that go to Python hold fewer rows from now on.

    Executors and workers each hold whole batches, several times over, and keep the memory.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_ROWS) == _DEFAULT_ROWS:
        conf.set(_BATCH_ROWS, str(TEXT_ROWS))
    return df


def release() -> None:
    """Hand memory that this worker has freed back to the system: workers outlive their tasks, and keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Other C libraries have no such call, and return memory in their own way.
        pass


def tidy(function):
    """A function over the batches of a task that releases freed memory at the end."""

    def run(stream):
        yield from function(stream)
        release()

    return run


# --- words of Arrow text columns ---------------------------------------------------


def filled(column) -> pa.LargeStringArray:
    """A text column with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def buffers(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a filled text column."""
    n = column.offset + len(column) + 1
    offsets = np.frombuffer(column.buffers()[1], np.int64, n)[column.offset:] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets


def pieces(column: pa.LargeStringArray):
    """(first row, last row, bytes, offsets) of row ranges of about PIECE_BYTES."""
    data, offsets = buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def gaps(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word number of each row (one more at the end)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~gaps(data)
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, offsets)


_ODD = 0x9E3779B97F4A7C15
_HALF = (1 << 64) - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers() -> dict:
    """Powers of an odd base modulo 2^64 and of its inverse, PIECE_BYTES of each, and a random value per byte."""
    known = worker_state("powers", dict)
    if not known:
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(PIECE_BYTES + 1, base, np.uint64)
            steps[0] = 1
            known[name] = np.cumprod(steps, dtype=np.uint64)
        rng = np.random.default_rng(20)
        known["bytes"] = rng.integers(1, _HALF, 256, np.uint64)
    return known


def _long_span(data: np.ndarray) -> int:
    """The polynomial of one span of any length, block by block."""
    known, total, scale = _powers(), 0, 1
    for first in range(0, len(data), PIECE_BYTES):
        part = data[first:first + PIECE_BYTES]
        total += scale * int(np.add.reduce(known["bytes"][part] * known["up"][:len(part)]))
        scale = scale * pow(_ODD, len(part), 1 << 64) % (1 << 64)
    return total % (1 << 64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans (in order, apart): a polynomial over random byte values, then scrambled.

    Spans are taken in groups that lie within PIECE_BYTES, so memory does not grow with the text; a hash does
    not depend on where its span stands.
    """
    known = _powers()
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = int(np.searchsorted(ends, base + PIECE_BYTES, "right"))
        if last <= first:
            out[first] = _long_span(data[base:ends[first]])
            first += 1
            continue
        part = data[base:ends[last - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(known["bytes"][part] * known["up"][:len(part)], out=sums[1:])
        at, to = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[to] - sums[at]) * known["down"][at]
        first = last
    return mixed(out + (ends - starts).astype(np.uint64))


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive hashes (across rows too: the caller masks those)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(_ODD) + hashes[i:len(hashes) - n + 1 + i]
    return mixed(out)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
