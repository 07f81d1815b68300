import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rivulet.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, node string, n string"


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows):
    """Smallest reachable id of each row."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            where[t].append(i)
    common = Counter((i, j) for found in where.values() for a, i in enumerate(found) for j in found[a + 1 :])
    for (i, j), o in common.items():
        if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(r.choice([12, 60, 400]))]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.6:
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        elif kind < 0.75:
            w = [r.choice(vocabulary) for _ in range(r.randrange(20))] + passage + [r.choice(vocabulary) for _ in range(r.randrange(20))]
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 8, 40, 90]))]
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 1024), (2, 8), (3, 5)])
def test_components_as_by_brute_force(spark, seed, size):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(5)
    got = jaccard.jaccard_join(df, "doc_id", "text", size=size).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


@pytest.mark.parametrize("size", [1024, 4])
def test_all_links_are_counted(spark, size):
    text = " ".join(f"w{i}" for i in range(40))
    near = [(1000 + i, text + f" x{i}") for i in range(12)] + [(2000, text), (2001, text), (2001, text), (None, text), (2002, None), (2003, " ")]
    rows = [*corpus(2, 120), *near]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(5)
    s = [shingles(t) for _, t in rows]
    want = Counter((d, sum(1 for j in range(len(rows)) if j != i and s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]))) for i, (d, _) in enumerate(rows))
    got = jaccard.jaccard_join(df, "doc_id", "text", size=size, links=True)
    assert got.columns == ["doc_id", "n_shingles", "class_id", "component_id", "n_links"]
    assert Counter((r.doc_id, r.n_links) for r in got.collect()) == want


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "two one"), (7, text), (7, text), (None, text), (None, None), (None, "only null here and no other row"), (9, text + " x")]
    df = spark.createDataFrame([(d, t, None, None) for d, t in rows], SCHEMA)
    got = jaccard.jaccard_join(df, "doc_id", "text").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    empty = jaccard.jaccard_join(df.limit(0), "doc_id", "text")
    assert empty.columns == ["doc_id", "n_shingles", "class_id", "component_id"] and empty.count() == 0


def test_overlap_bounds():
    for a in range(1, 60):
        for b in range(1, 60):
            need = jaccard.least_overlap(a, b)
            assert all((100 * o >= 80 * (a + b - o)) == (o >= need) for o in range(min(a, b) + 1))
    assert all(jaccard.prefix_length(n) == n - int(np.ceil(n * 4 / 5 - 1e-9)) + 1 for n in range(1, 500))


def test_tree_drops_no_pair_that_links():
    rng = np.random.default_rng(5)
    base = [np.sort(rng.choice(2**60, 200, replace=False).astype(np.uint64)) for _ in range(12)]
    parts = []
    for _ in range(150):
        s = base[rng.integers(12)].copy()
        s[rng.choice(200, rng.integers(0, 30), replace=False)] = rng.integers(2**60, 2**61, 1).astype(np.uint64)[0] + np.arange(1).astype(np.uint64)
        parts.append(np.unique(s))
    sizes = np.array([len(p) for p in parts])
    w = int(jaccard.width(sizes.max()))
    tree = jaccard.SignatureTree(np.stack([jaccard.bitmap(p, w) for p in parts]), sizes)
    got = {(int(i), int(j)) for x, y in tree.pairs(np.arange(150)) for i, j in zip(x, y, strict=True)}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if 100 * (o := jaccard.overlap(parts[i], parts[j])) >= 80 * (sizes[i] + sizes[j] - o)}
    assert want and want <= got


def test_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long + " more"), (2, long + " more"), (None, long), (3, "quite another text of seven words"), (4, None), (4, None), (5, "")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    out = jaccard.one_of_each(df, "doc_id", "text")
    assert out.columns == df.columns
    got = Counter(r.text for r in out.collect())
    assert sum(v for k, v in got.items() if k and k.startswith("w0")) == 1 and got["quite another text of seven words"] == 1 and got[None] == 2 and got[""] == 1
    unique = jaccard.one_of_each(df.where("doc_id IN (1, 3, 5)").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(9, long, "x", "y")], SCHEMA)), "doc_id", "text")
    assert sorted(r.doc_id for r in unique.collect()) == [1, 3, 5]


def test_sets_of_a_block_are_made_a_slice_at_a_time():
    import tracemalloc

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(4000)) for _ in range(250)] + ["", None, "a b"]
    array = jaccard.pa.array(texts)
    tracemalloc.start()
    parts = jaccard.each_set(array)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s, cut = jaccard.sets(array)
    assert len(parts) == len(texts) and all((p == s[a:b]).all() for p, a, b in zip(parts, cut[:-1], cut[1:], strict=True))
    assert most < 5 * sum(p.nbytes for p in parts)
