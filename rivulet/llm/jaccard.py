"""N-gram Jaccard join of texts by signature trees.

A text's set holds the hashes of its distinct shingles. Texts with equal sets are one
class. Two sets link when 100 * intersection >= percent * union; components are the
connected parts of that graph. The links are found in two rounds:

1.  Sets that share a min-hash meet in a block. There a signature tree is built over them:
    leaves hold a set's token bitmap and size, inner nodes the OR of their children's
    bitmaps and the range of their sizes. A dual traversal drops node pairs whose largest
    possible overlap is too small, or that are one component already; what is left is
    compared exactly. Most links are found here, which makes groups of copies small.
2.  Every linked pair shares a token in the prefixes of both sets under one global order
    (known-frequent tokens last), so sets of different components meet once more in the
    blocks of their prefix tokens, again in signature trees. Pairs that pass are compared
    exactly. This round makes the result whole whatever the first has found.

Only spanning links leave a block, so rows grow with the texts and not with the square of
a group. A block holds a bounded number of sets: larger ones are cut, and their parts meet
in pairs (round 2) or by representatives (round 1).

Sets and tokens are told apart by 64-bit hashes; between n different values a clash has
a chance of about n * n / 2 ** 65. Pairs are compared by the hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import hashed_words, map_slices, materialise, mix, settled, slices, table, with_row_id

WORDS, PERCENT = 5, 80
#: Sets in one tree, children of a tree node, bits of a bitmap a token at least, largest bitmap in 64-bit words.
BLOCK, FANOUT, BITS, MOST_WIDTH = 1024, 8, 1, 1 << 12
#: Sets at one token up to which all pairs are looked at before bitmaps are fetched.
FEW = 32
#: Tokens seen so often count as frequent and come last in prefixes; of the most frequent so many at most.
FREQUENT, MOST_FREQUENT = 16, 1 << 20
#: Bits of the filter that picks the texts to read again: 8 MB however many there are.
FILTER_BITS = 1 << 26
#: Parts of a min-hash's sets, by a hash of the set.
SALTS = 32
SEED = np.uint64(0x9E3779B97F4A7C15)
#: Min-hashes by which sets meet in the first round, and those by which the groups so found meet once more.
KEYS = ((0, 1), (2, 3, 4, 5))
SEEDS = mix(np.arange(1, 7, dtype=np.uint64) * SEED)


# --- sets ---------------------------------------------------------------------------------

def shingles(array: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, in order, and each one's text number.

    A text of fewer words has one shingle of all its words; without words it has none.
    """
    h, doc = hashed_words(array)
    prime = np.uint64(0x100000001B3)
    n = len(h) - words + 1
    if n > 0:
        whole = doc[:n] == doc[words - 1 :]
        s = h[:n].copy()
        for j in range(1, words):
            s = s * prime + h[j : n + j]
        s, of = mix(s[whole] + np.uint64(words)), doc[:n][whole]
    else:
        s, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(doc, minlength=len(array))
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        starts = np.cumsum(counts) - counts
        extra = []
        for d in few:
            x = np.uint64(0)
            with np.errstate(over="ignore"):
                for v in h[starts[d] : starts[d] + counts[d]]:
                    x = x * prime + v
                extra.append(x + np.uint64(counts[d]))
        s, of = np.concatenate((s, mix(np.array(extra, np.uint64)))), np.concatenate((of, few))
    return s, of


def sets(array: pa.Array, words: int = WORDS, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts and the bounds of each text's part.

    A part is sorted by hash; tokens in last (sorted) come after all others.
    """
    s, of = shingles(array, words)
    keys = [s, of]
    if last is not None and len(last):
        at = np.searchsorted(last, s)
        at[at == len(last)] = 0
        keys = [s, last[at] == s, of]
    order = np.lexsort(keys)
    s, of = s[order], of[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[keep], of[keep]
    return s, np.searchsorted(of, np.arange(len(array) + 1))


def each_set(array: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The set of each text, made from a slice of the texts at a time: besides the sets only a slice's words are held."""
    out = []
    for part in slices(pa.RecordBatch.from_arrays([array], names=["text"]), "text"):
        s, cut = sets(part.column(0), words)
        out += [s[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return out


def described(s: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's hash and its min-hashes (a row a set); zeros for empty sets."""
    n = np.diff(cut)
    some, at = n > 0, cut[:-1][n > 0]
    node, mins = np.zeros(len(n), np.uint64), np.zeros((len(n), len(SEEDS)), np.uint64)
    if len(at):
        node[some] = mix(np.add.reduceat(mix(s ^ SEED), at) + n[some].astype(np.uint64))
        for k, seed in enumerate(SEEDS):
            mins[some, k] = np.minimum.reduceat(mix(s + seed), at)
    return node, mins


def least_overlap(a, b, percent: int = PERCENT):
    """The overlap that sets of sizes a and b need to link."""
    return -((-percent * (a + b)) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    """So many first tokens of a set of n, of which a linked set has one among its own."""
    return n + 1 + ((-percent * n) // 100)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two arrays of distinct values."""
    c = np.sort(np.concatenate((a, b)))
    return int((c[1:] == c[:-1]).sum())


def width(n: np.ndarray) -> np.ndarray:
    """64-bit words of a set's bitmap: a power of two."""
    need = np.maximum(1, BITS * np.asarray(n) / 64)
    return np.minimum(MOST_WIDTH, 2 ** np.ceil(np.log2(need)).astype(np.int64))


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    at = (tokens >> np.uint64(20)) & np.uint64(64 * words - 1)
    bits = np.zeros(64 * words, np.uint8)
    bits[at.astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same tokens have with fewer words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


# --- trees --------------------------------------------------------------------------------

class SignatureTree:
    """Levels of nodes over sets in the order given; level 0 holds the sets."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT):
        slack = sizes - np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        self.fanout, self.levels = fanout, [(bitmaps, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > fanout:
            b, low, high, spare = self.levels[-1]
            at = np.arange(0, len(b), fanout)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        b, low, high, spare = self.levels[level]
        fits = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        i, j, at = i[fits], j[fits], np.flatnonzero(fits)
        need = least_overlap(low[i], low[j], percent)
        most = np.minimum(high[i], high[j])
        step = max(1, (1 << 21) // b.shape[1])
        for a in range(0, len(i), step):
            x, y = i[a : a + step], j[a : a + step]
            shared = np.bitwise_count(b[x] & b[y]).sum(axis=1, dtype=np.int64) + np.minimum(spare[x], spare[y])
            most[a : a + step] = np.minimum(most[a : a + step], shared)
        ok = np.zeros(len(fits), bool)
        ok[at] = most >= need
        return ok

    def pairs(self, group: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets (i < j) of different groups that may link, by dual traversal."""
        lows, highs = [group], [group]
        for _ in self.levels[1:]:
            at = np.arange(0, len(lows[-1]), self.fanout)
            lows.append(np.minimum.reduceat(lows[-1], at))
            highs.append(np.maximum.reduceat(highs[-1], at))
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        i, j = np.triu_indices(n)
        stack = [(top, i, j)]
        while stack:
            level, i, j = stack.pop()
            mixed = ~((lows[level][i] == highs[level][i]) & (lows[level][j] == highs[level][j]) & (lows[level][i] == lows[level][j]))
            i, j = i[mixed], j[mixed]
            if level == 0:
                apart = i != j
                i, j = i[apart], j[apart]
            ok = self._possible(level, i, j, percent)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield i, j
                continue
            below, step = len(self.levels[level - 1][0]), np.arange(self.fanout)
            for a in range(0, len(i), 4096):
                x = (i[a : a + 4096, None] * self.fanout + step)[:, :, None]
                y = (j[a : a + 4096, None] * self.fanout + step)[:, None, :]
                x, y = (v.ravel() for v in np.broadcast_arrays(x, y))
                keep = (x < below) & (y < below) & (x <= y)
                stack.append((level - 1, x[keep], y[keep]))


class _Groups:
    """Union-find over a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def all(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


def link_block(parts: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Group number of each set of a block, by exact comparison of all pairs that may link."""
    n = len(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.lexsort(([int(p[0]) for p in parts], sizes))
    groups = _Groups(n)
    linked = lambda i, j: 100 * (o := overlap(parts[i], parts[j])) >= percent * (len(parts[i]) + len(parts[j]) - o)
    close = lambda i, j: 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j])
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):  # neighbours first: copies of one text fall together
        if close(a, b) and linked(a, b):
            groups.join(a, b)
    if n > 2 and len(set(groups.all().tolist())) > 1:
        middle = int(order[n // 2])
        for i in range(n):
            if groups.root(i) != groups.root(middle) and close(i, middle) and linked(i, middle):
                groups.join(i, middle)
        w = int(width(sizes.max()))
        tree = SignatureTree(np.stack([bitmap(parts[i], w) for i in order]), sizes[order])
        for x, y in tree.pairs(groups.all()[order], percent):
            for i, j in zip(order[x].tolist(), order[y].tolist(), strict=True):
                if groups.root(i) != groups.root(j) and linked(i, j):
                    groups.join(i, j)
    return groups.all()


# --- columns ------------------------------------------------------------------------------

def _frequent(df: DataFrame, words: int) -> np.ndarray:
    """Sorted tokens that come often, by what each task sees twice or more; only the order of prefixes hangs on them."""
    def run(batches):
        held, size = [], 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            more = n > 1
            return pa.RecordBatch.from_arrays([pa.array(keys[more].view(np.int64)), pa.array(n[more])], names=["token", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                s, _ = shingles(part.column(0), words)
                held.append(s)
                size += len(s)
                if size >= 1 << 21:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counts = materialise(df.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "frequent")
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*")).collect()), reverse=True)
    least, total = 0, 0
    for b, n in steps:
        if total + n > MOST_FREQUENT:
            least = 1 << int(b + 1)
            break
        total += n
    return np.sort(counts.where(F.col("n") >= least).select("token").toArrow().column("token").to_numpy().view(np.uint64))


def _described(df: DataFrame, words: int, percent: int, last: np.ndarray) -> DataFrame:
    """doc_id and each text's set: n, node (its hash), min-hashes; and prefix tokens and bitmap, where the task hasn't seen the set before."""
    shared = df.sparkSession.sparkContext.broadcast(last)
    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("mins", longs), T.StructField("prefix", longs), T.StructField("bits", T.BinaryType())]

    def make():
        frequent, seen = shared.value, set()

        def fn(array: pa.Array) -> list:
            s, cut = sets(array, words, frequent)
            n = np.diff(cut)
            some = n > 0
            node, mins = described(s, cut)
            if len(seen) > 1 << 18:
                seen.clear()
            new = np.array([not (k in seen or seen.add(k)) for k in node.tolist()], bool) & some
            first = np.where(new, np.minimum(prefix_length(n, percent), n), 0)
            take = np.repeat(cut[:-1] - (np.cumsum(first) - first), first) + np.arange(first.sum())
            offsets = np.concatenate(([0], np.cumsum(first))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(s[take].view(np.int64)))
            w = width(n)
            bits = [bitmap(s[a:b], int(k)).tobytes() if x else None for a, b, k, x in zip(cut[:-1], cut[1:], w, new, strict=True)]
            return [n, node.view(np.int64), list(mins.view(np.int64)), prefix, bits]

        return fn

    return map_slices(df, "text", fields, make, ["doc_id"])


def _place(*cols):
    """A place in the filter for a value of its own hash, or for columns that are hashes already (by exclusive or)."""
    x = F.xxhash64(cols[0]) if len(cols) == 1 else cols[0].bitwiseXOR(F.shiftrightunsigned(cols[1], 11)).bitwiseXOR(cols[2])
    return F.pmod(x, F.lit(FILTER_BITS))


def _filter_of(places: DataFrame) -> np.ndarray:
    """A bit array in which the bits of column at are set: of one size however many there are."""
    at = F.col("at")
    words = places.select(F.floor(at / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _passing(df: DataFrame, ids: DataFrame, words: int, fields: str, rows) -> DataFrame:
    """What rows(batch of doc_id and text, sets, bounds) makes of the texts whose doc_id a filter over ids (column id) lets through."""
    bits = df.sparkSession.sparkContext.broadcast(_filter_of(ids.select(_place(F.col("id")).alias("at"))))
    hashed = df.select("doc_id", "text", _place(F.col("doc_id")).alias("at"))

    def run(batches):
        held = bits.value
        for batch in batches:
            some = batch.filter(pa.array(_held(held, batch.column(2).to_numpy())))
            for part in slices(some, "text"):
                yield rows(part, *sets(part.column(1), words))

    return hashed.mapInArrow(run, fields)


def _texts(df: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """wanted (node, rep: a document of it) -> node, text. Texts are read again; only those that a filter lets through are hashed and shuffled."""
    def rows(part, s, cut):
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(described(s, cut)[0].view(np.int64)), part.column(1)], names=["doc", "of", "text"])

    passed = _passing(df, wanted.select(F.col("rep").alias("id")).distinct(), words, "doc long, of long, text string", rows)
    return passed.join(wanted, F.col("doc").eqNullSafe(F.col("rep")) & (F.col("of") == F.col("node"))).select("node", "text")


def _runs(batches, key: int):
    """Tables of all rows with one value in column key, of batches sorted by it."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
            if held and held[0].column(key)[0].as_py() != int(k[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _block_links(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """rows (block, bin, node, text) -> a, b, bin, root and text of roots: links of each set to the smallest of its group."""
    def run(batches):
        for t in _runs(batches, 0):
            t = t.combine_chunks()
            node = t.column(2).to_numpy()
            _, first = np.unique(node, return_index=True)
            node = node[first]
            if len(node) < 2:
                root = node
            else:
                group = link_block(each_set(t.column(3).take(pa.array(first)).combine_chunks(), words), percent)
                root = node[group]  # nodes are sorted, and a group's number is its first member's
            roots = root == node
            text = pc.if_else(pa.array(roots), t.column(3).take(pa.array(first)), pa.scalar(None, pa.string()))
            text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(np.full(len(node), t.column(1)[0].as_py())), text], names=["a", "b", "bin", "text"])

    ready = rows.select("block", "bin", "node", "text").repartition("block").sortWithinPartitions("block")
    return ready.mapInArrow(run, "a long, b long, bin long, text string")


def _in_blocks(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows (bin, node, ...) with block; parts (cut, parts): bins that take several blocks."""
    x = rows.join(parts, F.col("bin") == F.col("cut"), "left").drop("cut")
    return x.withColumn("block", F.when(F.col("parts").isNull(), F.col("bin")).otherwise(F.xxhash64("bin", F.pmod(F.xxhash64("node"), F.col("parts"))))).drop("parts")


def _parts(rows: DataFrame, size: int) -> DataFrame:
    return rows.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") > size).select(F.col("bin").alias("cut"), F.ceil(F.col("n") / size).alias("parts"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, comp: the smallest node of each node's connected part.

    Each step a node takes the smallest label around it, then its label's label; the
    steps are written, so lineage stays short. Steps grow with the logarithm of a
    part's diameter, about.
    """
    e = edges.where("a <> b").select("a", "b")
    e = materialise(e.union(e.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialise(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("node"), "comp"), "labels")
    while True:
        around = e.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        met = labels.join(around, F.col("node") == F.col("a")).select("node", "comp", F.least("comp", "near").alias("to"))
        ups = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        jumped = met.join(ups, F.col("to") == F.col("n2"), "left").select("node", F.col("comp").alias("was"), F.least("to", F.coalesce("c2", "to")).alias("comp"))
        after = materialise(jumped, "labels")
        if not after.where("comp <> was").limit(1).count():
            return after.select("node", "comp")
        labels = after.select("node", "comp")


def _first_round(nodes: DataFrame, docs: DataFrame, words: int, percent: int, size: int, keys: tuple[int, ...], comps: DataFrame | None) -> DataFrame:
    """Spanning links (a, b) among sets with a common min-hash of keys; of sets that are one component already the smallest stands for all in a bin."""
    kept = nodes.select("node", "rep", F.array(*(F.col("mins")[k] for k in keys)).alias("mins"))
    if comps is not None:
        kept = kept.join(comps.select(F.col("node").alias("k"), "comp"), F.col("node") == F.col("k"), "left").select("node", "rep", "mins", F.coalesce("comp", "node").alias("comp"))
    else:
        kept = kept.withColumn("comp", F.col("node"))
    seen = kept.select("comp", "node", "rep", F.posexplode("mins").alias("key", "least"))
    seen = seen.groupBy("key", "least", "comp").agg(F.min(F.struct("node", "rep")).alias("x")).select("key", "least", "x.node", "x.rep")
    # a min-hash that many sets have is counted, and joined with its count, in parts
    seen = materialise(seen.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")), "seen")
    parts = seen.groupBy("key", "least", "salt").agg(F.count("*").alias("c"))
    several = parts.groupBy("key", "least").agg(F.sum("c").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    several = several.select(F.col("key").alias("k2"), F.col("least").alias("l2"), F.explode("salts").alias("s2"), "n")
    bins = seen.join(several, (F.col("key") == F.col("k2")) & (F.col("least") == F.col("l2")) & (F.col("salt") == F.col("s2"))).select("key", "least", "node", "rep", "n")
    bins = materialise(bins, "bins")
    if not bins.limit(1).count():
        return bins.select(F.col("node").alias("a"), F.col("node").alias("b"))
    # which (min-hash, set) take part is told by a filter; a text that passes by chance stands alone or links rightly
    least, node, key = F.col("least"), F.col("node"), F.col("key").cast("long")
    taking = docs.sparkSession.sparkContext.broadcast(_filter_of(bins.select(_place(least, node, key).alias("at"))))

    def rows(part, s, cut):
        of, mins = described(s, cut)
        pairs = [(i, k, mins[i, key]) for k, key in enumerate(keys) for i in range(len(of))]
        i, k = (np.array([p[j] for p in pairs], np.int64) for j in (0, 1))
        low = np.array([p[2] for p in pairs], np.uint64)
        at = (low ^ (of[i] >> np.uint64(11)) ^ k.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)
        some = _held(taking.value, at.astype(np.int64)) if len(i) else np.zeros(0, bool)
        i, k, low = i[some], k[some], low[some]
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(low.view(np.int64)), pa.array(of[i].view(np.int64)), part.column(1).take(pa.array(i))], names=["key", "least", "node", "text"])

    passed = _passing(docs, bins.select(F.col("rep").alias("id")).distinct(), words, "key long, least long, node long, text string", rows)
    rows_in = passed.select(F.xxhash64(F.col("key").cast("int"), "least").alias("bin"), "node", "text")
    cut = materialise(_parts(bins.select(F.xxhash64("key", "least").alias("bin")), size), "parts")
    out, links = materialise(_block_links(_in_blocks(rows_in, cut), words, percent), "links"), []
    while True:
        links.append(out.where("a <> b").select("a", "b"))
        # bins of several blocks: their groups' smallest sets meet once more, until one block holds them or none falls together
        roots = out.join(cut.select(F.col("cut").alias("c")), F.col("bin") == F.col("c"), "left_semi").where("a = b AND text IS NOT NULL").select("bin", F.col("a").alias("node"), "text")
        if not cut.limit(1).count():
            break
        again = _in_blocks(roots, materialise(_parts(roots, size), "parts"))
        after = materialise(_block_links(again, words, percent), "links")
        cut = materialise(_parts(roots, size), "parts")
        out = after
        if not out.where("a <> b").limit(1).count():
            break
    all_links = links[0]
    for x in [*links[1:], out.where("a <> b").select("a", "b")]:
        all_links = all_links.union(x)
    return all_links


def _meeting(rows: DataFrame, percent: int) -> DataFrame:
    """rows (token, node, comp, n, place) -> those of tokens at which sets of different components may meet first."""
    def run(batches):
        for t in _runs_many(batches):
            token, comp, n, place = (t.column(i).to_numpy() for i in (0, 2, 3, 4))
            cut = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(cut, len(token)))
            of = np.repeat(np.arange(len(cut)), size)
            low, high = np.minimum.reduceat(comp, cut), np.maximum.reduceat(comp, cut)
            keep = (low < high)[of]
            # a pair's places tell whether it may meet first here; larger bins go to a tree as they are
            for g in np.unique(size[(size <= FEW) & (low < high)]).tolist():
                bins = np.flatnonzero((size == g) & (low < high))
                for part in np.array_split(bins, max(1, len(bins) * g * g >> 20)):
                    i = cut[part, None] + np.arange(g)
                    a, b = n[i][:, :, None], n[i][:, None, :]
                    need, left = least_overlap(a, b, percent), (n - place)[i]
                    may = (comp[i][:, :, None] != comp[i][:, None, :]) & (left[:, :, None] >= need) & (left[:, None, :] >= need)
                    may &= (100 * a >= percent * b) & (100 * b >= percent * a)
                    keep[i] = may.any(axis=2)
            yield from t.filter(pa.array(keep)).to_batches()

    schema = "token long, node long, comp long, n long, place long"
    return rows.select("token", "node", "comp", "n", "place").repartition("token").sortWithinPartitions("token", "comp").mapInArrow(run, schema)


def _runs_many(batches):
    """Tables of whole runs of column 0, many at a time."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        k = t.column(0).to_numpy()
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if last:
            yield t.slice(0, last).combine_chunks()
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """rows (block, side, token, node, comp, n, place, bits) -> pairs (a < b) of different components that may link."""
    def run(batches):
        for t in _runs(batches, 0):
            node, comp, n, place, side = (t.column(c).to_numpy() for c in ("node", "comp", "n", "place", "side"))
            _, first = np.unique(node, return_index=True)
            first = first[np.lexsort((comp[first], n[first]))]
            node, comp, n, place, side = node[first], comp[first], n[first], place[first], side[first]
            bits = [np.frombuffer(t.column("bits")[int(i)].as_py(), np.uint64) for i in first]
            wide = np.array([len(b) for b in bits])
            for w in np.unique(wide):
                some = np.flatnonzero((wide == w) | (wide == 2 * w))
                if len(some) < 2 or not (wide[some] == w).any():
                    continue
                tree = SignatureTree(np.stack([folded(bits[i], w) for i in some]), n[some])
                for x, y in tree.pairs(np.unique(comp[some], return_inverse=True)[1], percent):
                    x, y = some[x], some[y]
                    need = least_overlap(n[x], n[y], percent)
                    ok = (comp[x] != comp[y]) & ((wide[x] == w) | (wide[y] == w)) & (n[x] - place[x] >= need) & (n[y] - place[y] >= need)
                    # of two blocks that meet, pairs within one are found where it meets itself
                    ok &= (side[x] != side[y]) | (side[x] < 0)
                    x, y = node[x[ok]], node[y[ok]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long").distinct()


def _marked(carried: DataFrame, comps: DataFrame) -> DataFrame:
    """carried's prefixes and whether a node may have a component: a filter tells those that surely have none."""
    bits = carried.sparkSession.sparkContext.broadcast(_filter_of(comps.select(_place(F.col("node")).alias("at"))))
    hashed = carried.select("node", "n", "prefix", _place(F.col("node")).alias("at"))

    def run(batches):
        held = bits.value
        for batch in batches:
            at = batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(_held(held, at))], names=["node", "n", "prefix", "maybe"])

    return hashed.mapInArrow(run, "node long, n long, prefix array<long>, maybe boolean")


def _second_round(nodes: DataFrame, carried: DataFrame, comps: DataFrame, docs: DataFrame, words: int, percent: int, size: int) -> DataFrame:
    """Links (a, b) between sets of different components, by their prefix tokens."""
    marked = _marked(carried, comps)
    known = comps.select(F.col("node").alias("k"), "comp")
    linked = marked.where("maybe").join(known, F.col("node") == F.col("k"), "left").select("node", "n", "prefix", F.coalesce("comp", "node").alias("comp"))
    placed = linked.union(marked.where("NOT maybe").select("node", "n", "prefix", F.col("node").alias("comp")))
    rows = placed.select("node", "comp", "n", F.posexplode("prefix").alias("place", "token")).withColumn("place", F.col("place").cast("long"))
    met = materialise(_meeting(rows, percent), "meeting")
    counts = met.groupBy("token").agg(F.count("*").alias("c")).select(F.col("token").alias("t"), F.ceil(F.col("c") / size).cast("int").alias("parts"))
    x = met.join(counts, F.col("token") == F.col("t")).drop("t").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # a token of several blocks: each two of them, and each by itself, meet in one tree
    other = F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))
    x = x.withColumn("other", F.explode(other))
    x = x.withColumn("block", F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other"))).withColumn("side", F.when(F.col("part") == F.col("other"), F.lit(-1)).otherwise(F.col("part")))
    some = met.select(F.col("node").alias("k")).distinct()
    bits = carried.join(some, F.col("node") == F.col("k"), "left_semi").groupBy(F.col("node").alias("k")).agg(F.max("bits").alias("bits"))
    pairs = materialise(_tree_pairs(x.join(bits, F.col("node") == F.col("k")).select("block", "side", "token", "node", "comp", "n", "place", "bits"), percent), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    wanted = nodes.join(ids, F.col("node") == F.col("k"), "left_semi").select("node", "rep")
    texts = materialise(_texts(docs, wanted, words), "texts")
    first = pairs.join(texts.select(F.col("node").alias("k"), F.col("text").alias("text_a")), F.col("a") == F.col("k")).select("a", "b", "text_a")
    both = first.join(texts.select(F.col("node").alias("k"), F.col("text").alias("text_b")), F.col("b") == F.col("k")).select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a"):
                one, cut1 = sets(part.column(2), words)
                two, cut2 = sets(part.column(3), words)
                ok = []
                for i in range(part.num_rows):
                    x, y = one[cut1[i] : cut1[i + 1]], two[cut2[i] : cut2[i + 1]]
                    o = overlap(x, y)
                    ok.append(100 * o >= percent * (len(x) + len(y) - o))
                yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def linked_sizes(parts: list[np.ndarray], copies: np.ndarray, side: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each set the copies of all sets it links with, by the exact overlaps of all pairs: those of different sides, or all if sides are negative."""
    m, n = len(parts), np.array([len(p) for p in parts], np.int64)
    token, at = np.unique(np.concatenate(parts), return_inverse=True)
    of = np.repeat(np.arange(m), n)
    # tokens of one set only are in no overlap
    shared = np.bincount(at, minlength=len(token)) > 1
    of, at = of[shared[at]], (np.cumsum(shared) - 1)[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    common = np.zeros((m, m), np.float32)  # whole numbers below 2 ** 24 are exact
    wide = min(2048, int(shared.sum()))
    for a in range(0, int(shared.sum()), max(1, wide)):
        low, high = np.searchsorted(at, (a, a + wide))
        has = np.zeros((m, wide), np.float32)
        has[of[low:high], at[low:high] - a] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    links = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    links &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
    np.fill_diagonal(links, False)
    return links @ copies


def _link_counts(base: DataFrame, of: DataFrame, docs: DataFrame, words: int, percent: int, size: int) -> DataFrame:
    """of (node, rep, comp) -> k (node), n_links: how many other rows each row of the set links with.

    All links lie within components. A component's sets are compared each with each, in
    one block or, for a large one, in a block for each two of its parts; what leaves a
    block is a row a set.
    """
    copies = base.where("n > 0").groupBy(F.col("node").alias("k")).agg(F.count("*").alias("copies"))
    several = of.groupBy(F.col("comp").alias("c")).agg(F.count("*").alias("m")).where("m > 1")
    members = of.join(several, F.col("comp") == F.col("c")).join(copies, F.col("node") == F.col("k")).select("node", "rep", "comp", "copies", F.ceil(F.col("m") / size).cast("int").alias("parts"))
    members = materialise(members, "members")
    texts = _texts(docs, members.select("node", "rep"), words).select(F.col("node").alias("k"), "text")
    x = members.join(texts, F.col("node") == F.col("k")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.withColumn("block", F.xxhash64("comp", F.least("part", "other"), F.greatest("part", "other"))).withColumn("side", F.when(F.col("part") == F.col("other"), F.lit(-1)).otherwise(F.col("part")))

    def run(batches):
        for t in _runs(batches, 0):
            node, first = np.unique(t.column(2).to_numpy(), return_index=True)
            t = t.take(pa.array(first)).combine_chunks()
            s, cut = sets(t.column(4).combine_chunks(), words)
            n = linked_sizes([s[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], t.column(3).to_numpy(), t.column(1).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n)], names=["node", "n"])

    ready = x.select("block", "side", "node", "copies", "text").repartition("block").sortWithinPartitions("block")
    others = ready.mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    return copies.join(others, F.col("k") == F.col("node"), "left").select("k", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))


def jaccard_join(df: DataFrame, doc_id: str, text: str, words: int = WORDS, percent: int = PERCENT, size: int = BLOCK, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, and n_links if links: one row for each row of df.

    class_id: the smallest doc_id of the rows with the same set; component_id: the
    smallest doc_id reachable by links. Null or empty texts, and texts of white space,
    have an empty set and link with nothing: both ids are their own. A null doc_id stays
    null and counts for nothing in a group with others. Repeated rows are of one class.
    Other columns are not looked at; an empty table gives no rows. n_links: how many other
    rows the row links with, rows of its own class included.
    """
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    base = materialise(_described(docs, words, percent, _frequent(docs, words)), "sets")
    # what describes a set is the same in all rows of its class
    same = [F.first(c).alias(c) for c in ("n", "mins")]
    nodes = materialise(base.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), *same), "nodes")
    carried = base.where("bits IS NOT NULL").select("node", "n", "prefix", "bits")
    spanning, comps = None, None
    for keys in KEYS:
        found = settled(lambda k=keys, c=comps: _first_round(nodes, docs, words, percent, size, k, c), "round1")
        spanning = found if spanning is None else spanning.union(found)
        comps = settled(lambda s=spanning: components(s), "components")
    more = settled(lambda: _second_round(nodes, carried, comps, docs, words, percent, size), "round2")
    if more.limit(1).count():
        comps = settled(lambda: components(spanning.union(more)), "components")
    of = nodes.select("node", "rep").join(comps.select(F.col("node").alias("k"), "comp"), F.col("node") == F.col("k"), "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = of.groupBy("comp").agg(F.min("rep").alias("component_id")).select(F.col("comp").alias("c"), "component_id")
    ids = of.join(least, F.col("comp") == F.col("c")).select(F.col("node").alias("k"), "rep", "component_id")
    out = base.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(ids, F.col("node") == F.col("k"), "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if links:
        counts = _link_counts(base, of, docs, words, percent, size)
        out = out.drop("k").join(counts, F.col("node") == F.col("k"), "left")
        columns.append(F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return out.select(*columns)


def one_of_each(df: DataFrame, doc_id: str, text: str, **limits) -> DataFrame:
    """df without the near copies: of each component the row of the smallest id stays.

    Where ids are null or repeated, rows get ids of their own first. Rows with an empty
    set all stay.
    """
    rows, row = with_row_id(df, doc_id)
    marks = jaccard_join(rows, row, text, **limits)
    copies = marks.where("doc_id <> component_id").select(F.col("doc_id").alias("__copy"))
    return rows.join(copies, F.col(f"`{row}`") == F.col("__copy"), "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def op1(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_shingles", "component_id")


def op1_links(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), "doc_id", "text", links=True).select("doc_id", "n_shingles", "component_id", "n_links")


#: For unique ids. All candidate pairs are counted, which suits small tables only.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)
), reached AS (
  SELECT doc_id, doc_id AS other FROM w
  UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT w.doc_id, CAST(coalesce(any_value(sizes.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM w JOIN reached ON reached.doc_id = w.doc_id LEFT JOIN sizes ON sizes.doc_id = w.doc_id GROUP BY w.doc_id
"""
OP1_LINKS_SQL = OP1_SQL.replace("min(other) AS component_id", "min(other) AS component_id, (SELECT count(*) FROM links l WHERE l.x = w.doc_id) AS n_links")
