"""What the document operators share: written tables, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting for the bytes of one Arrow batch, and what it is here: whole texts travel in batches, so that they are kept small.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

#: The white space of every contract here, as Java and Python patterns read it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Folders made where none was set, by application.
_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="barloom-")
        base = _OWN_DIRS[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/barloom-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The rows of df, computed once and kept as a table in the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._barloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes a table that written() made and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._barloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shipped(spark: SparkSession) -> None:
    """Gives executors this package as a zip, once per session, so that they need no copy on their own path."""
    context = spark.sparkContext
    if "barloom.zip" in context._python_includes:
        return
    root = Path(__file__).resolve().parents[1]
    place = Path(tempfile.mkdtemp(prefix="barloom-")) / "barloom.zip"
    with zipfile.ZipFile(place, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(str(place))


#: What this Python process keeps between tasks, by name.
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """This process's object of that name, made once; it goes when a task of by_arrow() that doesn't keep it begins."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def released(keep: str | None = None) -> None:
    """Drops what earlier tasks kept under other names, and gives the memory back to the machine."""
    if [_KEPT.pop(k) for k in list(_KEPT) if k != keep]:
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


def by_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: str | None = None) -> DataFrame:
    """mapInArrow in batches bounded by bytes (a setting of the session, changed only from Spark's default); keep names what tasks may keep()."""
    session = df.sparkSession
    shipped(session)
    if session.conf.get(BATCH_SETTING, None) in (None, "67108864b", "64MB", "64m"):
        session.conf.set(BATCH_SETTING, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released(keep)
        yield from f(batches)

    return df.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Short batches put together to longer ones, for small rows that are worked on in columns."""
    have: list[pa.RecordBatch] = []
    for batch in batches:
        have.append(batch)
        if sum(b.num_rows for b in have) >= rows:
            yield pa.concat_batches(have)
            have = []
    if have:
        yield pa.concat_batches(have)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; 0 for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % m, F.lit(0).cast("bigint"))


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    column = batch.column(name)
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `most` bytes together, with the place of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, texts[at:]


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64; those of up to two chunks are kept."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    both = []
    for x in (_BASE, _BACK):
        p = np.full(max(n, 1 << 16), x, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    if n <= 2 * CHUNK:
        _POWERS[:] = both
    return both[0][:n], both[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that give the hash of any slice of b, and the inverse powers."""
    p, q = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * p[: len(b)], out=sums[1:])
    return sums, q


def slice_hashes(sums: np.ndarray, back: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * back[start]


def hash_of(word: bytes) -> int:
    """The slice hash of one whole word."""
    sums, back = prefix_hashes(np.frombuffer(word, np.uint8))
    return int(slice_hashes(sums, back, np.array([0]), np.array([len(word)]))[0])


def cut_text(text: bytes, most: int = CHUNK) -> Iterator[bytes]:
    """A long text in parts of about `most` bytes that end at white space, so that no word is cut."""
    at = 0
    while len(text) - at > most:
        end = next((i for i in range(at + most, len(text)) if text[i] == 32 or 9 <= text[i] <= 13), len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and where each text's words begin (one more at the end)."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    turn = np.flatnonzero(np.diff(space, prepend=True))
    if len(turn) % 2:
        turn = np.append(turn, len(b))
    start, end = turn[0::2], turn[1::2]
    sums, back = prefix_hashes(b)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mixed(slice_hashes(sums, back, start, end)), np.concatenate([[0], np.searchsorted(start, ends)])
