"""What the corpus operators share: shared scratch storage, Arrow batches and word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of code points outside the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that one numpy step looks at; a longer single text is cut at white space.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch at most: texts are long, and a batch stands in the JVM and in Python at once.
BATCH_ROWS = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; the session's Arrow batches become no larger than BATCH_ROWS from here on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this process has written to the shared folder.
_WRITTEN: list[str] = []


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Deletes what operators have written to the shared folder so far, or from one place in the order of writing to another. For jobs to call once their results stand elsewhere: frames that operators returned may read these files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN[since:until]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    del _WRITTEN[since:until]


def written() -> int:
    """How many paths operators have written to and not released."""
    return len(_WRITTEN)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where neither the setting nor a checkpoint folder exists and all runs on one
    machine (tests) a local folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "rivulet-shared")
        sc.setCheckpointDir(base)
    _WRITTEN.append(f"{base.rstrip('/')}/rivulet/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, written; all that it has written on its way is deleted."""
    mark = written()
    out = materialise(make(), name)
    release(out.sparkSession, mark, written() - 1)
    return out


def with_row_id(df: DataFrame, doc_id: str) -> tuple[DataFrame, str]:
    """df and the name of a column that tells its rows apart: doc_id, or a new one if ids are null or repeated.

    The new ids hold for the rows as written, so the frame that is returned reads them.
    """
    odd = df.groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    if not odd.limit(1).count():
        return df, doc_id
    return materialise(materialise(df, "rows").withColumn("__row_id", F.monotonically_increasing_id()), "rows"), "__row_id"


def crc_rest(col, mod: int):
    """crc32 of an id's decimal text, modulo mod; a null id counts as 0's complement: training."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod)), F.lit(1))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of batch whose texts hold limit bytes at most (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def map_slices(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.Array], list]],
    keep: list[str] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """df's columns (those in keep) and new ones that a function makes of column.

    make() runs once a task and returns the function from an Arrow string array to
    the new columns. An input column with a new one's name is replaced.
    """
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    work = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{column}`").alias("__in"))
    types = None

    def run(batches):
        fn, out = make(), types
        for batch in batches:
            for part in slices(batch, "__in", limit):
                made = fn(part.column(part.schema.get_field_index("__in")))
                arrays = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    arrays + [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(made, out, strict=True)],
                    names=keep + [f.name for f in fields],
                )

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in fields]
    return work.mapInArrow(run, schema)


def texts(array: pa.Array) -> list[str]:
    """Python strings; null becomes the empty one."""
    return [x or "" for x in array.to_pylist()]


# --- words and their hashes -------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full((1 << 12) - 1, _POWER))), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    """The first n powers of the hash's base."""
    global _POWERS
    while len(_POWERS) < n:
        _POWERS = np.concatenate((_POWERS, _POWERS * _POWERS[-1] * _POWER))
    return _POWERS[:n]


def word_hashes(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-lower-cased words in buf, and for each word its text's number.

    buf: texts' UTF-8 bytes one after another, each followed by one space; starts:
    where each begins.
    """
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    first, end = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = end - first
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    values = _BYTE[_LOWER[buf[~space]]] * _powers(int(size.max()))[at]
    h = np.add.reduceat(values, np.cumsum(size) - size)
    return mix(h + size.astype(np.uint64)), np.searchsorted(starts, first, side="right") - 1


def joined(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a space after each, and the texts' starts."""
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = b" ".join(pc.fill_null(array.cast(pa.large_binary()), b"").to_pylist()) + b" "
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    return np.frombuffer(raw, np.uint8) if len(sizes) else np.zeros(0, np.uint8), starts


def hashed_words(array: pa.Array, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of an array of texts; a text beyond limit is looked at in parts."""
    buf, starts = joined(array)
    if len(buf) <= 2 * limit:
        return word_hashes(buf, starts)
    out, at = [], 0
    while at < len(buf):
        end = min(at + limit, len(buf))
        if end < len(buf):
            rest = np.flatnonzero(_SPACE[buf[end : end + limit]])
            while not len(rest) and end + limit < len(buf):
                end += limit
                rest = np.flatnonzero(_SPACE[buf[end : end + limit]])
            end = end + int(rest[0]) + 1 if len(rest) else len(buf)
        h, _ = word_hashes(buf[at:end], np.zeros(1, np.int64))
        space = _SPACE[buf[at:end]]
        first = np.flatnonzero(np.diff(space, prepend=True, append=True))[0::2] + at
        out.append((h, np.searchsorted(starts, first, side="right") - 1))
        at = end
    return np.concatenate([h for h, _ in out]), np.concatenate([d for _, d in out])


class Lookup:
    """Places of 64-bit keys by open addressing, for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]
            rest = self.place[slot] != left
            left, slot = left[rest], (slot[rest] + 1) & self.mask
        used = self.place >= 0
        self.keys[used] = keys[self.place[used]]

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * _POWER) >> self.shift).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each value among the keys, or -1."""
        slot = self._slot(x)
        out = self.place[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != x))
        while len(left):
            at = (slot[left] + 1) & self.mask
            slot[left] = at
            out[left] = self.place[at]
            left = left[(out[left] >= 0) & (self.keys[at] != x[left])]
        return out
