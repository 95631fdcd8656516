"""Shared helpers: shipping the package, shared storage, and vectorised word handling on UTF-8 buffers.

Texts reach Python as Arrow batches and are handled as UTF-8 bytes. Lower-casing A-Z and
splitting on ASCII separators are the same on UTF-8 bytes as on code points, so words are found
and hashed with numpy on the whole buffer, never with a Python loop over words.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import threading
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.Lock()
#: Where the C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_SHIPPED: set[str] = set()
_FALLBACK: dict[str, str] = {}

#: Bytes of text handled by one numpy call; longer single texts are handled alone.
SLICE_BYTES = 1 << 20


#: Rows and bytes of one Arrow batch, where the session leaves Spark's own (10,000 and 64 MB) as they are: a task holds
#: several copies of a batch, and texts are long.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20


# ---------------------------------------------------------------- session and storage
def ship(spark: SparkSession) -> None:
    """Make this package importable on executors, once for each application, and keep Arrow batches small."""
    sc = spark.sparkContext
    for key, default, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(ours))
    with _LOCK:
        if sc.applicationId in _SHIPPED:
            return
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="grafspan")
        path = os.path.join(folder, "grafspan_pkg.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(d, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(os.path.abspath(path))
        _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is read from spark.checkpoint.dir; where that is unset a temporary folder of this machine is used, in local
    mode only: on a cluster no folder of one machine will do.
    """
    sc = spark.sparkContext
    uri = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not uri:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise OSError("spark.checkpoint.dir has to name a folder that all executors share")
        with _LOCK:
            uri = _FALLBACK.setdefault(sc.applicationId, "file://" + os.path.join(tempfile.gettempdir(), f"grafspan-{uuid.uuid4().hex}"))
    if "://" not in uri:
        uri = ("file://" + os.path.abspath(uri)) if not uri.startswith("file:") else "file://" + uri[5:]
    return uri.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The folder below the shared one that holds all intermediate tables and files of this application."""
    return f"{shared_dir(spark)}/grafspan-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove this application's intermediate tables and files. Results read them until they are written, so this is
    for the caller, when all that is wanted has been written; token files that are to stay are to be copied before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder; it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as compressed Parquet below the shared folder and read it back; it stays until ``clean``.

    The shuffle files behind it aren't needed any more, but Spark lets them go only when the driver collects its
    garbage; it is asked to, lest they fill the executors' disks until it happens to."""
    spark, kind = df.sparkSession, df.schema
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(kind).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a file whole: to an attempt-specific name, then renamed, so that a retried task is harmless."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def open_file(uri: str) -> pa.NativeFile:
    """Random access to a shared file; memory-mapped where the store is a mounted folder."""
    fs, path = filesystem(uri)
    return pa.memory_map(path, "r") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def with_text_only(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


# ---------------------------------------------------------------- Arrow batches
def frugal(fn):
    """A function of Arrow batches that gives its worker's unused memory back when its partition is done: workers are
    reused, and what they keep adds up beside the executor's heap."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(lengths, limit: int = SLICE_BYTES):
    """Ranges (i, j) of consecutive items whose summed length stays below limit, or one longer item."""
    i, total = 0, 0
    for j, n in enumerate(lengths):
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if len(lengths) > i:
        yield i, len(lengths)


# ---------------------------------------------------------------- words
def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Words [^\x20\x09-\x0D]+
SPACE_WORDS = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM_WORDS = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
ORDER = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] of every span, the same wherever it lies. Spans are in order and apart."""
    out = np.empty(len(start), np.uint64)
    a, n = 0, len(start)
    while a < n:
        base = int(start[a])
        c = n if end[-1] - base <= 2 * SLICE_BYTES else min(n, max(a + 1, int(np.searchsorted(end, base + SLICE_BYTES))))
        seg = mix(values[base : int(end[c - 1])].astype(np.uint64) + _BASE)
        power, inverse = _powers(len(seg) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(seg * power[: len(seg)], out=sums[1:])
            s, e = start[a:c] - base, end[a:c] - base
            out[a:c] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        a = c
    return mix(out)


class Words:
    """Words of several texts in one buffer.

    buf: the lower-cased texts, one \\n after each; start, end: of every word; doc: its text;
    first: index of the first word of each text, with a last entry for the end.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray = SPACE_WORDS, lower: bool = True):
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        inside = table[raw].view(np.int8)
        step = np.diff(inside, prepend=np.int8(0))
        self.buf = raw
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word, the same in every batch and process."""
        out = np.empty(len(self.start), np.uint64)
        for i, j in pieces(list(self.offsets[1:] - self.offsets[:-1])):
            a, b = self.first[i], self.first[j]
            if a < b:
                self._hash_range(a, b, out)
        return mix(out)

    def _hash_range(self, a: int, b: int, out: np.ndarray) -> None:
        while a < b:
            base = self.start[a]
            c = b if self.end[b - 1] - base <= 2 * SLICE_BYTES else max(a + 1, int(np.searchsorted(self.end, base + SLICE_BYTES)))
            c = min(c, b)
            seg = self.buf[base : self.end[c - 1]]
            power, inverse = _powers(len(seg) + 1)
            with np.errstate(over="ignore"):
                sums = np.empty(len(seg) + 1, np.uint64)
                sums[0] = 0
                np.cumsum(_BYTE[seg] * power[: len(seg)], out=sums[1:])
                s, e = self.start[a:c] - base, self.end[a:c] - base
                out[a:c] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
            a = c

    def shingles(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of every run of n words within a text, in order; the position is implied by text order."""
        if len(hashes) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        m = len(hashes) - n + 1
        with np.errstate(over="ignore"):
            h = hashes[:m] * ORDER[0]
            for k in range(1, n):
                h = h + hashes[k : k + m] * ORDER[k]
        whole = self.doc[:m] == self.doc[n - 1 :]
        return mix(h[whole]), self.doc[:m][whole]
