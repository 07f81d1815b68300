"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Each language has a model of order 4: by order, a sorted array of 64-bit hashes of the
sequences it has seen, and their log probabilities beside it. What a language hasn't seen
backs off through its arrays of lower orders. So the models grow with what each language
has seen, not with languages times sequences. A text goes to the language of the lowest
cross-entropy per character. What is usual for a language is measured by folds: each
sampled text by a model that is made without the text's fold.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import crc_rest, map_slices, slices, table

ORDER = 4
#: Characters of sampled training text for each language, and for all of them together, in expectation.
FIT_CHARS, MOST_CHARS = 2 << 20, 32 << 20
#: Parts of the sample; each is measured by the models of the others.
FOLDS = 4
#: Standard deviations above a language's usual cross-entropy from which a text is rejected, at least.
LEAST_Z = 8.0
SLICE = 1 << 20
EDGE, GAP = 0, 32


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, 16 bits, or GAP for what is no letter.

    Letters beyond 16 bits take the codes below that no letter has, in turn, so they are
    never one with a letter of 16 bits; some of them share a code with each other.
    """
    lower = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)], np.int64)
    out = np.full(len(lower), GAP, np.uint16)
    near = (lower > 0) & (lower < 1 << 16)
    out[near] = lower[near]
    taken = np.zeros(1 << 16, bool)
    taken[lower[near]] = True
    free = np.flatnonzero(~taken)
    free = free[free >= 0x80]
    far = np.flatnonzero(lower >= 1 << 16)
    out[far] = free[lower[far] % len(free)]
    return out


def grams(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ORDER-character sequences of all texts, and each one's text number.

    Characters are folded letters; what stands between letters is one gap. Each text
    begins with ORDER - 1 edges, so no sequence reaches into another text.
    """
    strings = [(x or "").encode("utf-32-le") for x in array.to_pylist()]
    sizes = np.array([len(s) // 4 for s in strings], np.int64)
    letters = _folded()[np.frombuffer(b"".join(strings), np.uint32)]
    doc = np.repeat(np.arange(len(strings)), sizes)
    gap = letters == GAP
    keep = ~gap
    keep[1:] |= gap[1:] & (~gap[:-1] & (doc[1:] == doc[:-1]))
    letters, doc = letters[keep], doc[keep]
    sizes = np.bincount(doc, minlength=len(strings))
    pad = ORDER - 1
    at = np.arange(len(letters)) + pad * (doc + 1)
    line = np.full(len(letters) + pad * len(strings), EDGE, np.uint64)
    line[at] = letters
    key = np.zeros(len(at), np.uint64)
    for k in range(pad, -1, -1):
        key = (key << np.uint64(16)) | line[at - k]
    return key, doc


@dataclass(frozen=True)
class Levels:
    """One language's model, by order from ORDER down to 1."""
    #: Sorted hashes and log2 probabilities.
    keys: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]
    #: Of contexts: sorted hashes and log2 of the weight of the lower order.
    ctx_keys: tuple[np.ndarray, ...]
    ctx_logs: tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    levels: tuple[Levels, ...]
    #: log2 probability of a character below the lowest order.
    floor: float
    #: By language, of cross-entropy: its usual value, the variance between texts and a character, the cut.
    mean: np.ndarray
    between: np.ndarray
    within: np.ndarray
    cut: np.ndarray
    heat: float = 8.0


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return at, keys[at] == x


def _tail(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the last n characters."""
    return x & np.uint64((1 << (16 * n)) - 1)


def log_probs(levels: Levels, floor: float, x: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log2 probability of each sequence's last character in one language."""
    if order == 0:
        return np.full(len(x), floor)
    level = ORDER - order
    at, hit = _find(levels.keys[level], x)
    out = np.empty(len(x))
    out[hit] = levels.logs[level][at[hit]]
    y = x[~hit]
    if len(y):
        lower = log_probs(levels, floor, _tail(y, order - 1), order - 1)
        c, known = _find(levels.ctx_keys[level], y >> np.uint64(16))
        lower[known] += levels.ctx_logs[level][c[known]]
        out[~hit] = lower
    return out


def cross_entropies(model: Model, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: characters that count, and the summed cost (bits) in each language."""
    key, doc = grams(array)
    n = np.bincount(doc, minlength=len(array))
    cost = np.zeros((len(array), len(model.langs)))
    for a in range(0, len(key), SLICE):
        distinct, place = np.unique(key[a : a + SLICE], return_inverse=True)
        for j, levels in enumerate(model.levels):
            cost[:, j] -= np.bincount(doc[a : a + SLICE], weights=log_probs(levels, model.floor, distinct)[place], minlength=len(array))
    return n, cost


def _kneser_ney(counts: list[tuple[np.ndarray, np.ndarray]], langs: tuple[str, ...]) -> Model:
    """counts: for each language sorted hashes of ORDER characters and how often each came."""
    raw: list[list[tuple]] = []
    for keys, n in counts:
        levels = [(keys, n.astype(np.float64))]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: how many characters stand before
            k, c = np.unique(_tail(levels[-1][0], order), return_counts=True)
            levels.append((k, c.astype(np.float64)))
        raw.append(levels)
    floor = -float(np.log2(max(2, len(np.unique(np.concatenate([r[-1][0] for r in raw])))) + 1))
    made = []
    for levels in raw:
        logs, ctx_keys, ctx_logs = [None] * ORDER, [None] * ORDER, [None] * ORDER
        for level in range(ORDER - 1, -1, -1):
            keys, n = levels[level]
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            ctx, inv = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(inv, weights=n, minlength=len(ctx)), np.bincount(inv, minlength=len(ctx))
            weights = discount * kinds / total
            below = _tail(keys, ORDER - level - 1)
            lower = np.full(len(keys), 2**floor) if level == ORDER - 1 else 2.0 ** logs[level + 1][np.searchsorted(levels[level + 1][0], below)]
            logs[level] = np.log2((n - discount) / total[inv] + weights[inv] * lower)
            ctx_keys[level], ctx_logs[level] = ctx, np.log2(weights)
        small = lambda arrays: tuple(x.astype(np.float32) for x in arrays)
        made.append(Levels(tuple(k for k, _ in levels), small(logs), tuple(ctx_keys), small(ctx_logs)))
    zero = np.zeros(len(langs))
    return Model(langs, tuple(made), floor, zero, zero, zero, zero + LEAST_Z)


def _counted(df: DataFrame) -> DataFrame:
    """(lang: a number, fold, text) -> lang, fold, gram, n: counted on the executors, summed over all."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                of = part.column(0).to_numpy() * FOLDS + part.column(1).to_numpy()
                key, doc = grams(part.column(2))
                for j in np.unique(of):
                    k, n = np.unique(key[of[doc] == j], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), x, np.int32)) for x in divmod(j, FOLDS)] + [pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "fold", "gram", "n"])

    return df.mapInArrow(run, "lang int, fold int, gram long, n long").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


def _measured(df: DataFrame, folds: list[Model]) -> DataFrame:
    """(lang, fold, text) -> lang, n and cost in each language, by the model without the text's fold; texts without a letter are left out."""
    shared = df.sparkSession.sparkContext.broadcast(folds)

    def run(batches):
        models = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                fold = part.column(1).to_numpy()
                for f in np.unique(fold):
                    some = part.filter(pa.array(fold == f))
                    n, cost = cross_entropies(models[f], some.column(2))
                    keep = n > 0
                    yield pa.RecordBatch.from_arrays([some.column(0).filter(pa.array(keep)), pa.array(n[keep]), pa.array(list(cost[keep]), pa.list_(pa.float64()))], names=["lang", "n", "cost"])

    return df.mapInArrow(run, "lang int, n long, cost array<double>")


def fit(df: DataFrame, doc_id: str, text: str, lang: str, chars: int = FIT_CHARS, most: int = MOST_CHARS) -> Model | None:
    """Models of all languages in df, from a sample by a hash of the id: chars characters a language in expectation, most for all together.

    Rows without text or language take no part; None if no row is left. A language of few
    texts is fitted as any other: all its texts count, and calibration by folds never
    measures a text by itself. The counts are made on the executors; what comes to the
    driver is one row a distinct sequence, language and fold, so no more than the sample.
    """
    known = df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull() & (F.length(f"`{text}`") > 0)).select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    totals = {r[0]: r[1] for r in known.groupBy("lang").agg(F.sum(F.length("text"))).collect()}
    if not totals:
        return None
    langs = tuple(sorted(totals))
    each = min(chars, most / len(langs))
    # null and repeated ids: the length tells them apart, so that they aren't drawn all or none
    draw = F.pmod(F.xxhash64(F.lit("language"), "id", F.length("text")), F.lit(1 << 24)) / F.lit(float(1 << 24))
    number = F.create_map(*(F.lit(v) for j, x in enumerate(langs) for v in (x, j)))
    share = F.element_at(F.array(*(F.lit(min(1.0, each / totals[x])) for x in langs)), F.col("lang") + 1)
    fold = F.pmod(F.xxhash64(F.lit("part"), "id", F.length("text")), F.lit(FOLDS)).cast("int")
    sample = known.select(number[F.col("lang")].alias("lang"), fold.alias("fold"), "text", draw.alias("draw")).where(F.col("draw") < share).drop("draw")
    rows = _counted(sample).toArrow()
    of, part, gram, n = (rows.column(c).to_numpy() for c in ("lang", "fold", "gram", "n"))
    order = np.lexsort((gram.view(np.uint64), of))
    of, part, gram, n = of[order], part[order], gram[order].view(np.uint64), n[order]
    cut = np.searchsorted(of, np.arange(len(langs) + 1))

    def model(without: int) -> Model:
        counts = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            keep = part[a:b] != without
            k, c = gram[a:b][keep], n[a:b][keep]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
            counts.append((k[first], np.add.reduceat(c, first) if len(first) else c))
        return _kneser_ney(counts, langs)

    return _calibrated(model(-1), _measured(sample, [model(f) for f in range(FOLDS)]).toPandas())


def _calibrated(model: Model, seen) -> Model:
    """Cross-entropy's usual spread, the cut above it and the heat of the scores, from labelled texts. A language's cut follows its own texts only."""
    if not len(seen):
        return model
    of, n, cost = seen["lang"].to_numpy(), seen["n"].to_numpy(float), np.stack(seen["cost"].to_numpy())
    h = cost / n[:, None]
    own = h[np.arange(len(h)), of]
    mean = np.array([np.median(own[of == j]) if (of == j).any() else np.median(own) for j in range(len(model.langs))])
    off = np.abs(own - mean[of])
    long = n >= np.median(n)
    between = np.full(len(model.langs), max(1e-4, (1.4826 * np.median(off[long])) ** 2))
    within = np.full(len(model.langs), 9.0)  # squared bits a character, about the spread of single costs
    z = (own - mean[of]) / np.sqrt(between[of] + within[of] / n)
    cut = np.array([max(LEAST_Z, 1.25 * float(np.quantile(z[of == j], 0.999))) if (of == j).any() else LEAST_Z for j in range(len(model.langs))])
    best = (np.inf, 1.0)
    for heat in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        s = -heat * h
        s -= s.max(axis=1, keepdims=True)
        loss = -(s[np.arange(len(h)), of] - np.log(np.exp(s).sum(axis=1))).mean()
        best = min(best, (loss, heat))
    return Model(model.langs, model.levels, model.floor, mean, between, within, cut, best[1])


def identify(df: DataFrame, text: str, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, lang_score (0 to 1), cross_entropy (bits a character) and rejected.

    Null text, or a text without a letter: lang_pred und, score 0, rejected. Other texts
    always get a learned language; rejected tells that the cross-entropy lies further
    above that language's than the calibrated cut. Ties go to the first language by code
    point. Without a model every text is und. Equal texts get equal results. Long texts
    are read whole; columns with these names are replaced, others kept; an empty table
    stays empty.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def fn(array: pa.Array) -> list:
            found = [any(c.isalpha() for c in (t or "")) for t in array.to_pylist()]
            if m is None:
                return [["und"] * len(array), [0.0] * len(array), [None] * len(array), [True] * len(array)]
            n, cost = cross_entropies(m, array)
            h = cost / np.maximum(n, 1)[:, None]
            best = h.argmin(axis=1)
            low = h[np.arange(len(h)), best]
            score = 1 / np.exp(-m.heat * (h - low[:, None])).sum(axis=1)
            z = (low - m.mean[best]) / np.sqrt(m.between[best] + m.within[best] / np.maximum(n, 1))
            return [
                [m.langs[b] if ok else "und" for b, ok in zip(best, found, strict=True)],
                [float(s) if ok else 0.0 for s, ok in zip(score, found, strict=True)],
                [float(x) if ok else None for x, ok in zip(low, found, strict=True)],
                [not ok or bool(x) for x, ok in zip(z > m.cut[best], found, strict=True)],
            ]

        return fn

    return map_slices(df, text, fields, make, keep, limit=SLICE)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_rest("doc_id", 5) == 0)
    model = fit(docs.where(~F.col("held_out")), "doc_id", "text", "lang")
    out = identify(docs, "text", model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "cross_entropy", "rejected")
