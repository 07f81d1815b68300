"""Quality classifier from zstandard dictionaries of good and of bad labelled text.

A text is compressed, block by block and whole, with either dictionary. The difference
of the compressed sizes, divided by the number of bytes, becomes a probability of the
good label by a logistic curve fitted on the labelled rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import crc_rest, map_slices, table

#: Bytes of each dictionary.
DICT_BYTES = 112 << 10
#: Samples are trained on in pieces of so many bytes; a dictionary is made of segments of so many.
PIECE, SEGMENT = 4096, 256
#: Bytes that are compressed at a time; small, as a dictionary helps the start of a block most.
BLOCK = 1024
LEVEL = 3
#: Labelled rows that are looked at for fitting, and bytes of their texts' sum, at most, in expectation.
FIT_ROWS, FIT_BYTES = 6000, 24 << 20


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    base: float
    #: Score of a text without bytes.
    prior: float


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary over all samples: what comes in most of them stands in it.

    Samples too few to train on, a few kilobytes together, are the dictionary themselves.
    """
    pieces = [s[a : a + PIECE] for s in samples for a in range(0, len(s), PIECE)]
    try:
        return zstd.train_dictionary(size, pieces, k=SEGMENT, d=8).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(pieces) or b"\n"


def _own_lines(texts: list[bytes]) -> list[bytes]:
    """Texts without lines that stand in another text too: passages that are passed around tell no quality."""
    lines = [t.split(b"\n") for t in texts]
    seen = Counter(x for ls in lines for x in set(ls))
    return [b"\n".join(x for x in ls if seen[x] == 1) for ls in lines]


class Compressors:
    def __init__(self, model: Model, level: int = LEVEL):
        self.pair = []
        for raw in (model.good, model.bad):
            d = zstd.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self.pair.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False))

    def difference(self, data: bytes) -> float:
        """(size by the bad dictionary - size by the good one) per byte; over 0: nearer to good text."""
        good, bad = self.pair
        total = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            total += len(bad.compress(block)) - len(good.compress(block))
        return total / len(data) if data else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and base of a logistic curve by Newton's method with a light ridge."""
    X, w = np.stack((x, np.ones_like(x)), 1), np.zeros(2)
    ridge = np.diag([1e-4, 1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + ridge, X.T @ (y - p) - ridge @ w)
        w += np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(rows: list[tuple[str | None, int]], dict_bytes: int = DICT_BYTES) -> Model:
    """rows: texts and labels (1 good, 0 bad), in a fixed order. Half make the dictionaries, half the curve; every row takes part."""
    made, held = rows[0::2], rows[1::2]
    own = _own_lines([(t or "").encode() for t, _ in made])
    data = lambda label: [t for t, (_, y) in zip(own, made, strict=True) if y == label]
    model = Model(_dictionary(data(1), dict_bytes), _dictionary(data(0), dict_bytes), 0.0, 0.0, 0.5)
    known = [((t or "").encode(), y) for t, y in held if t]
    if not known:
        return model
    c = Compressors(model)
    x, y = np.array([c.difference(d) for d, _ in known]), np.array([float(v) for _, v in known])
    scale = float(x.std()) or 1.0
    slope, base = _logistic(x / scale, y)
    empty = [v for t, v in rows if not t]
    prior = (sum(empty) + y.mean()) / (len(empty) + 1)
    return Model(model.good, model.bad, slope / scale, base, float(prior))


def _draw(seed: str, *cols):
    """Uniform in [0, 1) by a hash of cols."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 24)) / F.lit(float(1 << 24))


def _below(draw, label: str, share: dict):
    return draw < F.coalesce(*(F.when(F.col(label) == y, F.lit(s)) for y, s in share.items()), F.lit(0.0))


def fit_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label_id: str, label: str, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """Fits on a sample of labelled rows, drawn by a hash of the id, as large as rows and size (bytes) allow.

    Both labels are drawn with equal expected numbers, so that a rare label has enough.
    Rows with a null label or text take no part; without both labels every score is the
    prior. Ids are drawn among the labels alone, so the side that is broadcast holds rows
    ids in expectation; the texts' bytes are then summed, and fewer drawn if they are too many.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(label_id).isNotNull()).select(F.col(label_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    true = {r[0]: r[1] for r in known.groupBy("__label").agg(F.count("*")).collect()}
    if len(true) < 2:
        return fit([])
    share = {y: min(1.0, rows / 2 / n) for y, n in true.items()}
    picked = known.where(_below(_draw("fit", "__id"), "__label", share))
    found = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("__doc"), F.col(text).alias("__text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    sums = {r[0]: (r[1], r[2] or 0) for r in found.groupBy("__label").agg(F.count("*"), F.sum(F.octet_length("__text"))).collect()}
    fewer = {y: min(1.0, rows / 2 / n, size / 2 / max(b, 1)) for y, (n, b) in sums.items()}
    got = found.where(_below(_draw("row", "__id", "__text"), "__label", fewer)).select(F.md5(F.col("__id").cast("string")).alias("k"), "__text", "__label").collect() if fewer else []
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    model = fit([(r[1], r[2]) for r in got])
    have = {y: sum(r[2] == y for r in got) for y in true}
    if not all(have.values()):
        return model
    # the sample's odds are not the table's
    shift = np.log(true[1] / true[0]) - np.log(have[1] / have[0])
    return Model(model.good, model.bad, model.slope, model.base + float(shift), model.prior)


def score(df: DataFrame, text: str, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds quality_score (0 to 1) and size_difference (per byte, null for a text without bytes).

    Null and empty texts get the model's prior. Equal texts get equal scores; texts are
    compressed whole, however long, a block at a time. Columns with these names are
    replaced, other columns of any name kept; an empty table stays empty.
    """
    fields = [T.StructField("quality_score", T.DoubleType()), T.StructField("size_difference", T.DoubleType())]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        c = Compressors(m)

        def fn(array: pa.Array) -> list:
            x = [c.difference(t.encode()) if t else None for t in (v or "" for v in array.to_pylist())]
            return [[m.prior if d is None else float(1 / (1 + np.exp(-np.clip(m.slope * d + m.base, -30, 30)))) for d in x], x]

        return fn

    return map_slices(df, text, fields, make, keep)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "quality")
    train = labels.where(crc_rest("label_id", 5) != 0)
    model = fit_sample(docs, train, "doc_id", "text", "label_id", "quality")
    out = score(docs.withColumn("held_out", crc_rest("doc_id", 5) == 0), "text", model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))
