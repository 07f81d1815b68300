"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

Each byte is eight binary decisions; at each decision there is a context tree over the
bytes before it, up to a depth, with a Krichevsky-Trofimov estimator in every node. The
block probability of a node depends on its counts alone, so the tree is weighted from
counts of byte sequences, which are made over the whole training set on the executors:

    P_w(node) = 1/2 P_kt(node) + 1/2 product of P_w(children)

The posterior weight of "stop here" against "go deeper" then mixes the nodes' estimates
along the path of a context. A path ends at a context that training has not seen.

The whole tree is kept, spread over tasks: contexts with the same nearest bytes make one
part of it, and what stands above the parts is small and goes to all tasks. Texts are
scored with the most frequent sequences at hand; each of the others is asked of its part,
once a chunk of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import Lookup, crc_rest, hashed_words, map_slices, materialise, slices, table

#: Bytes of context.
DEPTH = 5
#: Largest number of (context, byte) pairs, and of words, that go to every task. Beyond it, rarer ones are joined instead.
MOST_PAIRS, MOST_WORDS = 1 << 20, 1 << 19
#: Bytes of context that tell a pair's part of the tree, pairs in a part about, and bytes of text that ask together.
STEM, PART, CHUNK = 3, 1 << 14, 1 << 24
#: Keys that a counting task holds before it passes them on, and bytes of text that are looked at at once.
FLUSH, SLICE = 1 << 20, 1 << 19


# --- byte sequences -----------------------------------------------------------------------

def sequences(array: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, and an end byte 0 after it: the depth bytes before it and itself, packed.

    Before a text stand zeros. Also each one's text number.
    """
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    gap = b"\0" * (depth + 1)
    line = np.frombuffer(gap[1:] + gap.join(pc.fill_null(array.cast(pa.large_binary()), b"").to_pylist()) + b"\0", np.uint8)
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.arange(len(doc)) + depth * doc + depth
    key = np.zeros(len(doc), np.uint64)
    for j in range(depth, -1, -1):
        key = (key << np.uint64(8)) | line[at - j]
    return key, doc


def _counted(df: DataFrame, text: str, depth: int) -> DataFrame:
    """kind (0 byte sequence, 1 word), key, n over all texts; texts counted in kind 2.

    Each task adds up what it has seen and passes it on when it grows large, so rows
    follow the distinct sequences and words of each task.
    """
    def run(batches):
        held: dict[int, list] = {0: [], 1: []}
        size = {0: 0, 1: 0}

        def flush(kind):
            k = np.concatenate([x for x, _ in held[kind]])
            n = np.concatenate([x for _, x in held[kind]])
            order = np.argsort(k)
            k, n = k[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            held[kind] = [(k[first], np.add.reduceat(n, first))]
            size[kind] = len(first)

        def out(kind):
            for k, n in held[kind]:
                for a in range(0, len(k), 1 << 16):
                    part = k[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[a : a + (1 << 16)])], names=["kind", "key", "n"])
            held[kind], size[kind] = [], 0

        texts = 0
        for batch in batches:
            for part in slices(batch, "text", 2 * SLICE):
                texts += part.num_rows
                for kind, (keys, _) in ((0, sequences(part.column(0), depth)), (1, hashed_words(part.column(0)))):
                    k, n = np.unique(keys, return_counts=True)
                    held[kind].append((k, n))
                    size[kind] += len(k)
                    if size[kind] > FLUSH:
                        flush(kind)
                        if size[kind] > FLUSH // 2:
                            yield from out(kind)
        for kind in held:
            if held[kind]:
                flush(kind)
                yield from out(kind)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _least(counts: DataFrame, by: str, most: int) -> int:
    """The smallest power of two such that at most `most` rows have as much in column by."""
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2(by)).alias("b")).agg(F.count("*")).collect()), reverse=True)
    total = 0
    for b, n in steps:
        if total + n > most:
            return 1 << int(b + 1)
        total += n
    return 1


# --- the tree -----------------------------------------------------------------------------

def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x of 1/2 or more, by Stirling's series after a shift."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(y), shift)
        y = np.where(low, y + 1, y)
    s = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + s / 12 - s**3 / 360 + s**5 / 1260 - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    out = np.empty(len(a))
    for i in range(0, len(a), 1 << 17):
        x, y = a[i : i + (1 << 17)].astype(np.float64), b[i : i + (1 << 17)].astype(np.float64)
        out[i : i + (1 << 17)] = _lgamma(x + 0.5) + _lgamma(y + 0.5) - _lgamma(x + y + 1) - np.log(np.pi)
    return out


@dataclass(frozen=True)
class Tree:
    """By depth from 0: sorted keys (context bytes, then the decision's place), chance of a one, weight of stopping."""
    keys: tuple[np.ndarray, ...]
    one: tuple[np.ndarray, ...]
    stop: tuple[np.ndarray, ...]
    #: By depth: sequences that training has seen, packed as in sequences(), and the log10
    #: probability of the last byte if the path ends at that depth.
    pairs: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]


def _decisions(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (context, byte) pairs -> node keys, zeros and ones."""
    ctx, byte = pairs >> np.uint64(8), pairs & np.uint64(255)
    keys, zeros, ones = [], [], []
    for i in range(8):
        node = (ctx << np.uint64(8)) | (np.uint64(1 << i) | (byte >> np.uint64(8 - i)))
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
        bit = (byte >> np.uint64(7 - i)) & np.uint64(1)
        total, one = (np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64) for x in (n, n * bit.astype(np.int64)))
        keys.append(node[first])
        zeros.append(total - one)
        ones.append(one)
    k, z, o = np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)
    order = np.argsort(k)
    return k[order], z[order], o[order]


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of n."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _levels(key: np.ndarray, n: np.ndarray, depths: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sequences and their counts, cut to each depth."""
    return [_summed(key & np.uint64((1 << (8 * d + 8)) - 1), n) for d in depths]


def _weigh(counts: list[tuple[np.ndarray, np.ndarray]], top: int = 0, below: np.ndarray | None = None) -> tuple[Tree, tuple[np.ndarray, np.ndarray]]:
    """counts: by depth from top, sorted (context, byte) pairs and how often they came; below: log weighted probability under each deepest node, if those aren't leaves.

    Also, if top is over 0, the keys of the nodes above and what these have below.
    """
    nodes = [_decisions(*c) for c in counts]
    stop: list = [None] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        k, z, o = nodes[i]
        kt = log_kt(z, o)
        weighted = kt if below is None else np.logaddexp(kt, below) - np.log(2)
        stop[i] = (np.ones(len(k)) if below is None else np.exp(kt - np.log(2) - weighted)).astype(np.float32)
        if i + top:
            # a node's key without its farthest byte is its parent's
            above, below = _summed(k & np.uint64((1 << (8 * (i + top))) - 1), weighted)
    one = tuple(((o + 0.5) / (z + o + 1)).astype(np.float32) for _, z, o in nodes)
    return Tree(tuple(k for k, _, _ in nodes), one, tuple(stop), (), ()), (above, below) if top else (np.zeros(0, np.uint64), np.zeros(0))


def build(counts: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """A tree that one task holds. counts: by depth from 0, sorted (context, byte) pairs and how often they came."""
    tree, _ = _weigh(counts)
    logs = []
    for d, (pairs, _) in enumerate(counts):
        upto = Tree(tree.keys[: d + 1], tree.one[: d + 1], tree.stop[: d + 1], (), ())
        logs.append(_path_logs(upto, pairs))
    return Tree(tree.keys, tree.one, tree.stop, tuple(p for p, _ in counts), tuple(logs))


def _path_logs(tree: Tree, x: np.ndarray) -> np.ndarray:
    """path_logs() in bounded steps."""
    parts = [path_logs(tree, x[a : a + (1 << 16)]).astype(np.float32) for a in range(0, len(x), 1 << 16)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def path_logs(tree: Tree, x: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence's last byte after the bytes before it, decision by decision."""
    out = np.zeros(len(x))
    ctx, byte = x >> np.uint64(8), x & np.uint64(255)
    for i in range(8):
        place = np.uint64(1 << i) | (byte >> np.uint64(8 - i))
        bit = ((byte >> np.uint64(7 - i)) & np.uint64(1)).astype(bool)
        p = np.full(len(x), 0.5)
        found = []
        live = np.ones(len(x), bool)
        for d, keys in enumerate(tree.keys):
            node = ((ctx & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | place
            at = np.searchsorted(keys, node)
            at[at == len(keys)] = 0
            live = live & (keys[at] == node) if len(keys) else live & False
            found.append((at, live))
        for d in range(len(tree.keys) - 1, -1, -1):
            at, live = found[d]
            if not live.any():
                continue
            deeper = found[d + 1][1] if d + 1 < len(found) else np.zeros(len(x), bool)
            here = tree.one[d][at]
            p = np.where(live, np.where(deeper, tree.stop[d][at] * here + (1 - tree.stop[d][at]) * p, here), p)
        out += np.log10(np.where(bit, p, 1 - p))
    return out


class Scorer:
    """path_logs() by look-up in a tree of build(): the path of a context ends at the deepest depth at which training has seen it."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.pairs = [Lookup(p) for p in tree.pairs]
        self.contexts = [Lookup(np.unique(p >> np.uint64(8))) for p in tree.pairs]

    def logs(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), 8 * np.log10(0.5))
        left = np.arange(len(x))
        for d in range(len(self.pairs) - 1, -1, -1):
            y = x[left] & np.uint64((1 << (8 * d + 8)) - 1)
            at = self.pairs[d].find(y)
            hit = at >= 0
            out[left[hit]] = self.tree.logs[d][at[hit]]
            left, y = left[~hit], y[~hit]
            if not len(left):
                break
            # a byte that is new in a known context: decision by decision
            new = self.contexts[d].find(y >> np.uint64(8)) >= 0
            if new.any():
                keys, inv = np.unique(y[new], return_inverse=True)
                upto = Tree(self.tree.keys[: d + 1], self.tree.one[: d + 1], self.tree.stop[: d + 1], (), ())
                out[left[new]] = path_logs(upto, keys)[inv]
            left = left[~new]
        return out


@dataclass(frozen=True)
class Language:
    #: The tree's nodes above its parts, and the counts that parts are made of: part, key, n.
    top: Tree
    grams: DataFrame
    parts: int
    depth: int
    #: Frequent sequences, sorted, and the log10 probability of each one's last byte.
    pairs: np.ndarray
    logs: np.ndarray
    #: Frequent words' sorted hashes and counts; the other words of training stand in a table.
    words: np.ndarray
    counts: np.ndarray
    rare: DataFrame | None
    ends: int
    n_tokens: int
    n_kinds: int

    def word_log(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n_tokens + 0.1 * (self.n_kinds + 1)))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x = df.toArrow()
    k, n = x.column("key").to_numpy().view(np.uint64), x.column("n").to_numpy()
    order = np.argsort(k)
    return k[order], n[order]


def _part(depth: int, parts: int):
    """The part of the tree for a sequence in column key."""
    return F.pmod(F.xxhash64(F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * min(STEM, depth))) - 1))), F.lit(parts)).cast("int")


def _below(grams: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the nodes right above the parts, sorted, and the log weighted probability under each, by the parts' tasks."""
    stem = min(STEM, depth)

    def run(t: pa.Table) -> pa.Table:
        counts = _levels(t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy(), range(stem, depth + 1))
        key, below = _weigh(counts, stem)[1]
        return pa.table({"key": key.view(np.int64), "below": below})

    # decimals: sums that don't depend on the order of rows
    got = grams.groupBy("part").applyInArrow(run, "key long, below double").groupBy("key").agg(F.sum(F.col("below").cast("decimal(28,10)")).cast("double").alias("n"))
    return _arrays(got)


def _answers(asks: DataFrame, grams: DataFrame, top: Tree, depth: int, parts: int) -> DataFrame:
    """asks (chunk, at, key) -> chunk, at, key, log: log10 probability of the key's last byte in the whole tree."""
    stem = min(STEM, depth)
    shared = asks.sparkSession.sparkContext.broadcast(top)

    schema = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("key", pa.int64()), ("log", pa.float32())])

    def run(have: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return schema.empty_table()
        key, inv = np.unique(asked.column("asked").to_numpy().view(np.uint64), return_inverse=True)
        # a side without rows has no columns either
        seen, n = (have.column(c).to_numpy() if have.num_rows else np.zeros(0, np.int64) for c in ("key", "n"))
        up, (own, _) = shared.value, _weigh(_levels(seen.view(np.uint64), n, range(stem, depth + 1)), stem)
        log = _path_logs(Tree(up.keys + own.keys, up.one + own.one, up.stop + own.stop, (), ()), key)[inv]
        return pa.table([asked.column("chunk"), asked.column("at"), asked.column("asked"), pa.array(log)], schema=schema)

    # asks may come from grams: names of their own keep the two sides' columns apart
    placed = asks.select("chunk", "at", F.col("key").alias("asked"), _part(depth, parts).alias("to"))
    return grams.groupBy("part").cogroup(placed.groupBy("to")).applyInArrow(run, "chunk long, at int, key long, log float")


def learn(df: DataFrame, text: str, depth: int = DEPTH, most_pairs: int = MOST_PAIRS, most_words: int = MOST_WORDS) -> Language:
    """Counts all of df's texts (null: empty) and weights the tree.

    The counts are written to the shared folder, and all of them make the tree. What comes
    to the driver and goes to the tasks is bounded by most_pairs, most_words and the
    different sequences of STEM bytes. Repeated rows count each; other columns are not
    looked at; very long texts are counted in slices of whole texts; an empty table makes
    a model without counts.
    """
    counted = materialise(_counted(df, text, depth), "counts")
    grams, words = counted.where("kind = 0").select("key", "n"), counted.where("kind = 1").select("key", "n")
    parts = max(1, grams.count() // PART)
    grams = grams.select(_part(depth, parts).alias("part"), "key", "n")
    stem = min(STEM, depth)
    short = F.col("key").bitwiseAND(F.lit((1 << (8 * stem)) - 1))
    key, n = _arrays(grams.groupBy(short.alias("key")).agg(F.sum("n").alias("n")))
    top, _ = _weigh(_levels(key, n, range(stem)), 0, _below(grams, depth)[1])
    often = grams.where(F.col("n") >= _least(grams, "n", most_pairs))
    asks = often.select(F.lit(0).cast("long").alias("chunk"), F.lit(0).alias("at"), "key")
    pairs, logs = _arrays(_answers(asks, grams, top, depth, parts).select("key", F.col("log").alias("n")))
    ends = counted.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = _least(words, "n", most_words)
    keys, counts = _arrays(words.where(F.col("n") >= least))
    rare = words.where(F.col("n") < least) if least > 1 else None
    return Language(top, grams, parts, depth, pairs, logs, keys, counts, rare, ends, n_words + ends, kinds + (ends > 0))


def score(df: DataFrame, text: str, model: Language, keep: list[str]) -> DataFrame:
    """keep and n_tokens, n_known, base_score, score, bits_per_byte for each row.

    Tokens are the words and one end a text. Null or empty texts: the end alone.
    base_score is the smoothed word model's log10 probability, score that of the context
    tree, the text's end included. Words that are not among the frequent ones are joined
    with the table of the others by their hash, once a text and word. Sequences that are
    not among the frequent ones get a number in their chunk of text, and the answers of
    the tree's parts come back to the chunk.

    Columns of keep with a result's name are replaced; repeated rows are scored alike, an
    empty table stays empty, and a model of no texts gives each byte a chance of 1/256.
    A very long text is scored whole, in bounded steps.
    """
    keep = [c for c in keep if c not in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")]
    shared = df.sparkSession.sparkContext.broadcast((model.pairs, model.logs, model.words, model.counts, model.depth))
    end_log, zero = float(model.word_log(np.float64(model.ends))), model.n_tokens + 0.1 * (model.n_kinds + 1)
    fields = [T.StructField("__row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("__known", T.LongType()), T.StructField("__base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("__other", T.ArrayType(T.LongType())), T.StructField("__times", T.ArrayType(T.LongType())), T.StructField("__bytes", T.LongType()), T.StructField("__chunk", T.LongType()), T.StructField("__left", T.ArrayType(T.IntegerType())), T.StructField("__asked", T.ArrayType(T.LongType())), T.StructField("__first", T.IntegerType())]
    ends_known = int(model.ends > 0)

    def make():
        pairs, logs, words, counts, depth = shared.value
        known_pairs, known_words = Lookup(pairs), Lookup(words)
        word_logs = np.log10((counts + 0.1) / zero)
        row = TaskContext.get().partitionId() << 36
        chunk, size_of_chunk = TaskContext.get().partitionId() << 24, 0
        # the chunk's sequences so far, sorted, and their numbers
        asked, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)

        def fn(array: pa.Array) -> list:
            nonlocal row, chunk, size_of_chunk, asked, number
            size = len(array)
            h, doc = hashed_words(array)
            n = np.bincount(doc, minlength=size)
            at = known_words.find(h)
            hit = at >= 0
            base = np.bincount(doc[hit], weights=word_logs[at[hit]], minlength=size) + end_log
            known = np.bincount(doc, weights=hit, minlength=size).astype(np.int64) + ends_known
            other = np.flatnonzero(~hit)
            of, word = doc[other], h[other]
            order = np.lexsort((word, of))
            of, word = of[order], word[order]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), (of[1:] != of[:-1]) | (word[1:] != word[:-1]))))
            times = np.diff(np.append(first, len(of)))
            of, word = of[first], word[first].view(np.int64)
            cut = np.searchsorted(of, np.arange(size + 1))
            key, of = sequences(array, depth)
            at = np.concatenate([known_pairs.find(key[a : a + SLICE]) for a in range(0, len(key), SLICE)])
            hit = at >= 0
            total = np.bincount(of[hit], weights=logs[at[hit]], minlength=size)
            lengths = np.bincount(of, minlength=size)
            if size_of_chunk > CHUNK:
                chunk, size_of_chunk, asked, number = chunk + 1, 0, asked[:0], number[:0]
            size_of_chunk += len(key)
            u, inv = np.unique(key[~hit], return_inverse=True)
            to = np.searchsorted(asked, u)
            old = np.zeros(len(u), bool)
            old[to < len(asked)] = asked[to[to < len(asked)]] == u[to < len(asked)]
            numbers, first_new = np.empty(len(u), np.int32), len(asked)
            numbers[old] = number[to[old]]
            numbers[~old] = first_new + np.arange((~old).sum())
            asked, number = np.insert(asked, to[~old], u[~old]), np.insert(number, to[~old], numbers[~old])
            rest = np.concatenate(([0], np.cumsum(np.bincount(of[~hit], minlength=size)))).astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(rest), pa.array(numbers[inv].astype(np.int32)))
            # what a slice asks stands in its first row
            new = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.full(size, (~old).sum()))).astype(np.int32)), pa.array(u[~old].view(np.int64)))
            rows = np.arange(row, row + size)
            row += size
            lists = lambda v: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(np.ascontiguousarray(v)))
            return [rows, n + 1, known, base, total, lists(word), lists(times), lengths, np.full(size, chunk), left, new, np.full(size, first_new, np.int32)]

        return fn

    # row numbers hold for what is written only
    written = materialise(map_slices(df, text, fields, make, keep, SLICE), "scored")
    asks = written.where(F.size("__asked") > 0).select(F.col("__chunk").alias("chunk"), "__first", F.posexplode("__asked").alias("place", "key"))
    answers = _answers(asks.select("chunk", (F.col("__first") + F.col("place")).alias("at"), "key"), model.grams, model.top, model.depth, model.parts).select("chunk", "at", "log")

    def add(rows: pa.Table, got: pa.Table) -> pa.Table:
        logs = np.zeros(got.num_rows)
        logs[got.column("at").to_numpy()] = got.column("log").to_numpy()
        left = rows.column("left").combine_chunks()
        of = np.repeat(np.arange(rows.num_rows), pc.list_value_length(left).to_numpy(zero_copy_only=False))
        more = np.bincount(of, weights=logs[left.flatten().to_numpy()], minlength=rows.num_rows)
        return pa.table({"of": rows.column("of"), "more": more})

    waiting = written.where(F.size("__left") > 0).select(F.col("__row").alias("of"), F.col("__chunk").alias("chunk"), F.col("__left").alias("left"))
    mores = waiting.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add, "of long, more double")
    scored = written.join(mores, F.col("__row") == F.col("of"), "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    scored = scored.withColumn("bits_per_byte", -F.col("score") / F.lit(float(np.log10(2))) / F.col("__bytes"))
    if model.rare is None:
        rest = F.aggregate("__times", F.lit(0).cast("long"), lambda a, x: a + x)
        out = scored.withColumn("base_score", F.col("__base") + rest * F.lit(float(model.word_log(np.float64(0))))).withColumn("n_known", F.col("__known"))
    else:
        asked = written.select("__row", F.explode(F.arrays_zip("__other", "__times")).alias("x")).select("__row", F.col("x.__other").alias("word"), F.col("x.__times").alias("times"))
        got = asked.join(model.rare.withColumnRenamed("n", "c"), F.col("word") == F.col("key"), "left")
        c = F.coalesce(F.col("c"), F.lit(0))
        # decimals: sums that don't depend on the order of rows
        log = (F.log10((c + F.lit(0.1)) / F.lit(zero)) * F.col("times")).cast("decimal(28,14)")
        sums = got.groupBy(F.col("__row").alias("r")).agg(F.sum(log).cast("double").alias("b"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k"))
        out = scored.join(sums, F.col("__row") == F.col("r"), "left").withColumn("base_score", F.col("__base") + F.coalesce("b", F.lit(0.0))).withColumn("n_known", F.col("__known") + F.coalesce("k", F.lit(0)))
    return out.select(*(F.col(f"`{c}`") for c in keep), "n_tokens", "n_known", "base_score", "score", "bits_per_byte")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_rest("doc_id", 10) == 0)
    model = learn(docs.where(~F.col("held_out")), "text")
    out = score(docs, "text", model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
