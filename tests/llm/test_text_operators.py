"""BPE, quality rules, language identification, classifier, context trees: against brute force and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from rivulet.llm import bpe, common, compression, ctw, language, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\t", "a", "Ünïcode \u2028 text\x00with\x1f odd  spaces \U0001F600", "x" * 5000, "a b " * 3000, "The THE the", "1234 5678", "\\</turn> ### |<>#"]
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", "clash", 1) for i, t in enumerate(ODD)] + [(0, None, None, None, None, None), (4, "a", "en", "s", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, n_tokens int").repartition(3)


# --- shared ---

def test_word_hashes_follow_words():
    texts = ["The quick  brown", None, "", "THE\tquick\nbrown fox", " x ", "quick"]
    h, doc = common.hashed_words(pa.array(texts, pa.string()))
    words = [(i, w) for i, t in enumerate(texts) for w in WORD.findall((t or "").lower())]
    assert [d for d, _ in words] == doc.tolist()
    by = defaultdict(set)
    for (_, w), x in zip(words, h.tolist(), strict=True):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_long_texts_are_hashed_in_parts():
    r = random.Random(1)
    texts = [" ".join(str(r.randrange(1000)) for _ in range(3000)), "y" * 5000 + " z", ""]
    a, d = common.hashed_words(pa.array(texts))
    b, e = common.hashed_words(pa.array(texts), limit=777)
    assert (a == b).all() and (d == e).all()


def test_lookup():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 3000, dtype=np.uint64))
    x = np.concatenate((keys[::3], keys[::5] + np.uint64(1), np.zeros(1, np.uint64)))
    want = {k: i for i, k in enumerate(keys.tolist())}
    assert common.Lookup(keys).find(x).tolist() == [want.get(k, -1) for k in x.tolist()]
    assert (common.Lookup(keys[:0]).find(x) == -1).all()


# --- byte-level BPE ---

def test_parts_give_the_same_ids():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(["ab", " ", "  ", "\n", "\t ", "7", "'s", "!", "é", "\u3000", "\x1c", "\U0001F600", "don't "]) for _ in range(r.randrange(400)))
        assert "".join(bpe.parts(text, 10)) == text
        ids = np.concatenate([np.zeros(0, "<u4"), *[bpe.encode_text(p, RANKS, public_tokenizers.PATTERN) for p in bpe.parts(text, 10)]])
        assert ids.tolist() == enc.encode_ordinary(text)


def test_very_long_runs():
    for text in ("a" * 300_000, " " * 300_000 + "x", "ab1!" * 80_000):
        ids = bpe.encode_text(text, RANKS, public_tokenizers.PATTERN)
        assert bpe.decode_ids(ids, RANKS, public_tokenizers.PATTERN) == text.encode()


def test_round_trip(odd):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for r in bpe.encode(odd, "text", RANKS, public_tokenizers.PATTERN, decode=True).collect():
        want = enc.encode_ordinary(r.text or "")
        assert r.n_tokens == len(want) and np.frombuffer(r.token_ids, "<u4").tolist() == want and bytes(r.decoded) == (r.text or "").encode()
    packed = bpe.encode(odd, "text", RANKS, public_tokenizers.PATTERN)
    assert packed.columns.count("n_tokens") == 1 and packed.limit(0).count() == 0
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode(packed, "token_ids", RANKS, public_tokenizers.PATTERN).collect())
    digests = bpe.token_digests(odd, "text", RANKS, public_tokenizers.PATTERN, ["doc_id", "text", "n_tokens"])
    assert digests.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in digests.collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# --- quality rules ---

def brute_rules(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, odd):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "b", " ", " ", "\n", "#", "É", "9", "."]) for _ in range(r.randrange(300))) for _ in range(80)]
    texts += ["a b c d e f a b c d e", "l1\nl1\n\n \nl1", "one two three four five " * 40]
    df = odd.unionByName(spark.createDataFrame([(100 + i, t, "en", "s", "c", 1) for i, t in enumerate(texts)], odd.schema))
    got = rules.quality_rules(df, "text", "lang", ["doc_id", "text", "kept"]).collect()
    assert len(got) == df.count()
    for x in got:
        want = brute_rules(x.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (x.base_failed and x.kept)


def _prose(r, words, n):
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


WORDS = {"en": ["the", "of", "and", "to", "in", "is"], "fr": ["de", "la", "le", "et", "les", "un"], "pl": ["i", "w", "na", "z", "do", "nie"]}


def test_divergence(spark):
    r = random.Random(6)
    words = {"en": WORDS["en"] * 3 + [f"{a}{b}inging" for a in "bcdfgh" for b in "aeiou"], "fr": WORDS["fr"] * 3 + [f"{a}{b}mentes" for a in "bcdfgh" for b in "éèêou"], "pl": WORDS["pl"] * 3 + [f"{a}{b}ością" for a in "łżśćp" for b in "aeęóy"]}
    good = [(i * 3 + j, _prose(r, words[lang], 120), lang) for i in range(60) for j, lang in enumerate(("en", "fr", "pl"))]
    # a language of five texts, and clean texts whose language is unknown or stands nowhere else
    few = [(800 + i, _prose(r, ["que", "el", "los", *(f"{a}{b}iendo" for a in "bcdft" for b in "aeiou")], 90), "es") for i in range(5)]
    alone = [(850, _prose(r, ["och", "att", "det", *(f"{a}{b}ningen" for a in "bkls" for b in "aeouä")], 90), "sv"), (851, _prose(r, words["pl"], 90), None)]
    bad = [(900, " ".join(f"{a}%%% ###" for a in words["en"]) + " $$$" * 60, "en"), (901, " ".join(f"{r.randrange(10**6)}" for _ in range(200)), "en"), (902, _prose(r, ["zzkq", "qqxw", "wwvu", "kkzx", "vvqz", "pqzy"], 3), "en"), (903, _prose(r, [f"{a}{b}zzzzz" for a in "qwxyz" for b in "kjvhf"], 150), "pl")]
    docs = spark.createDataFrame(good + few + alone + bad, "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in rules.quality_rules(docs, "text", "lang", ["doc_id"]).collect()}
    assert [(d, lang, out[d].class_distance, out[d].common_distance, out[d].base_failed) for d, _, lang in good + few + alone if not out[d].kept] == []
    assert not any(out[d].kept for d in (900, 901, 903)) and out[902].class_distance is None and out[851].class_distance is None
    top = {x["__lang"]: x["__words"] for x in rules.common_words(docs, "text", "lang").collect()}
    assert set(WORDS["pl"]) <= set(top["pl"]) and set(WORDS["en"]) <= set(top["en"]) and len(top["en"]) <= rules.COMMON_WORDS
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, kept string, n_words int")
    none = rules.quality_rules(empty, "text", "lang", ["doc_id", "text", "kept", "n_words"])
    assert none.count() == 0 and none.columns == ["doc_id", "text", *rules.BASE, *rules.VERDICT]


def test_distance(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.2, 0.3, 0.4]
    got = spark.range(1).select(rules.distance(*(rules.F.array(*map(rules.F.lit, x)) for x in (p, q))).alias("d")).first().d
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    assert got == pytest.approx(math.sqrt((kl(p, m) + kl(q, m)) / 2))


# --- language ---

@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(8)
    parts = {"en": ["th", "er", "on", "an", "re", "he", "in", "ed"], "de": ["sch", "ein", "ung", "ver", "ge", "ß", "ü", "ich"], "fr": ["eau", "é", "è", "que", "tion", "aux", "ç", "oi"]}
    rows = []
    for i in range(360):
        lang = r.choice(sorted(parts))
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.choice([3, 20, 60]))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def brute_kneser_ney(texts, order=4):
    """Probability function of characters by the textbook recursion."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        line = "\0" * (order - 1) + t
        for i in range(order - 1, len(line)):
            counts[order][line[i - order + 1 : i + 1]] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1

    def discount(k):
        once, twice = sum(v == 1 for v in counts[k].values()), sum(v == 2 for v in counts[k].values())
        return once / (once + 2 * twice) if once and twice else 0.5

    d = [discount(k) for k in range(1, order + 1)]
    totals, kinds = defaultdict(float), defaultdict(int)
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            totals[k, g[:-1]] += n
            kinds[k, g[:-1]] += 1

    def p(g, k, size):
        if not k:
            return 1 / (size + 1)
        lower = p(g[1:], k - 1, size)
        total = totals.get((k, g[:-1]))
        if not total:
            return lower
        return max(counts[k].get(g, 0) - d[k - 1], 0) / total + d[k - 1] * kinds[k, g[:-1]] / total * lower

    return p, counts


def test_kneser_ney_as_by_the_recursion():
    texts = {"en": ["the then there her", "other the re"], "de": ["schein ver ung", "ich schung"]}
    counts, models = [], {}
    for lang in sorted(texts):
        key, _ = language.grams(pa.array(texts[lang]))
        counts.append(np.unique(key, return_counts=True))
        models[lang] = brute_kneser_ney(texts[lang])
    model = language._kneser_ney(counts, tuple(sorted(texts)))
    size = len({c for p, n in models.values() for c in n[1]})
    probe = "there schon qx the"
    key, _ = language.grams(pa.array([probe]))
    line = "\0\0\0" + probe
    for j, lang in enumerate(sorted(texts)):
        want = [math.log2(models[lang][0](line[i - 3 : i + 1], 4, size)) for i in range(3, len(line))]
        assert language.log_probs(model.levels[j], model.floor, key) == pytest.approx(want, abs=1e-3)


def test_languages_are_told(spark, languages, odd):
    model = language.fit(languages.where("doc_id % 3 <> 0"), "doc_id", "text", "lang")
    got = language.identify(languages, "text", model).where("doc_id % 3 = 0").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and np.mean([r.rejected for r in got]) < 0.05
    for r in language.identify(odd, "text", model).collect():
        none = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == none and 0 <= r.lang_score <= 1 and (r.rejected or not none)
    junk = spark.createDataFrame([(1, "xqzj wvkq zzxj qqkv jxwz " * 20)], "doc_id long, text string")
    assert language.identify(junk, "text", model).first().rejected
    assert language.fit(odd.limit(0), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in language.identify(odd, "text", None).collect()} == {"und"}


def test_language_query_as_by_the_recursion(spark, languages, tmp_path):
    """op8's prediction is the least cost by the textbook recursion, with a language of three texts, null and repeated rows."""
    r = random.Random(18)
    few = [(1000 + i, " ".join(r.choice(["szcz", "łódź", "wie", "przy", "ść"]) + r.choice(["ego", "ych", "ami"]) for _ in range(50)), "pl") for i in range(6)]
    odd = [(2000, None, "en"), (2001, "", "de"), (2002, "123 \U0001F600", "fr"), (2003, "\U00010400\U00020000 \U00031350\u4e2d", None), (None, "there is an edge on the hill", "en"), (5, "eau tion aux", None)]
    rows = [tuple(x) for x in languages.collect()] + few + odd
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = language.op8(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    def folded(t):
        out = ""
        for c in t:
            c = c.lower()[0] if c.isalpha() else " "
            if c != " " or (out and out[-1] != " "):
                out += c
        return out

    models, langs = {}, sorted({x[2] for x in rows if x[2]})
    for lang in langs:
        models[lang] = brute_kneser_ney([folded(t) for d, t, la in rows if la == lang and t and (d is None or zlib.crc32(str(d).encode()) % 5)])
    size = len({g for _, n in models.values() for g in n[1]})
    by_id = {x.doc_id: x for x in got}
    wrong = 0
    for d, text, lang in [*r.sample(rows[:360], 25), *few, *odd]:
        x = by_id[d]
        assert 0 <= x.score <= 1
        if not any(c.isalpha() for c in text or ""):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0.0, True)
            continue
        line = "\0\0\0" + folded(text)
        cost = {la: -sum(math.log2(models[la][0](line[i - 3 : i + 1], 4, size)) for i in range(3, len(line))) / (len(line) - 3) for la in langs}
        if max(map(ord, text)) < 1 << 16 and list(r_[0] for r_ in rows).count(d) == 1:
            assert x.lang_pred == min(langs, key=cost.get) and x.cross_entropy == pytest.approx(min(cost.values()), abs=2e-3)
        wrong += lang is not None and d is not None and x.lang_pred != lang
    assert wrong <= 2 and all(by_id[d].lang_pred == "pl" and not by_id[d].rejected for d, *_ in few)
    # letters beyond 16 bits are letters, and are none of 16 bits
    assert by_id[2003].lang_pred != "und"
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert language.op8(spark, str(tmp_path / "none")).count() == 0


def test_a_rare_language_moves_no_other(spark, languages):
    """One text of another language leaves the cuts and usual values of the rest as they are, nearly."""
    with_one = languages.union(spark.createDataFrame([(9999, "szcz łódź przy " * 9, "pl")], languages.schema))
    a, b = (language.fit(x, "doc_id", "text", "lang") for x in (languages, with_one))
    for j, lang in enumerate(a.langs):
        k = b.langs.index(lang)
        assert b.mean[k] == pytest.approx(a.mean[j], abs=0.02) and b.cut[k] == pytest.approx(a.cut[j], rel=0.05)
    low = language._folded()
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    assert all(low[c] != language.GAP for c in letters) and not set(low[[c for c in letters if ord(chr(c).lower()[0]) > 0xFFFF]]) & set(low[[c for c in letters if ord(chr(c).lower()[0]) <= 0xFFFF]])


# --- classifier ---

def test_classifier(spark, odd):
    r = random.Random(9)
    good, bad = [f"{a}{b}ly" for a in "bcdfghm" for b in "aeiou"], ["BUY", "!!!", "$$$", "click", "###", "now"]
    rows = [(i, " ".join(r.choice(good if i % 3 else bad) for _ in range(80)), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select(docs.doc_id.alias("label_id"), "quality")
    model = compression.fit_sample(docs.select("doc_id", "text"), labels.where("label_id < 200"), "doc_id", "text", "label_id", "quality")
    held = compression.score(docs.where("doc_id >= 200"), "text", model).collect()
    assert np.mean([(x.quality_score >= 0.3) == bool(x.quality) for x in held]) > 0.95
    for x in compression.score(odd, "text", model).collect():
        assert 0 <= x.quality_score <= 1 and (x.size_difference is None) == (not x.text)
    assert compression.fit_sample(docs.limit(0), labels.limit(0), "doc_id", "text", "label_id", "quality").prior == 0.5


def test_classifier_query_as_by_plain_compression(spark, tmp_path):
    """op10 over a table with null, empty, repeated and very long texts, against zstandard itself."""
    import zstandard as zstd

    r = random.Random(19)
    good, bad = [f"{a}{b}ly" for a in "bcdfghm" for b in "aeiou"], ["BUY", "!!!", "$$$", "click", "###", "now", "cheap"]
    texts = [" ".join(r.choice(good if i % 4 else bad) for _ in range(r.randrange(5, 200))) for i in range(400)]
    texts += [None, "", " ", texts[0], " ".join(good) * 2000]
    rows = [(i, t, i % 7) for i, t in enumerate(texts)] + [(None, texts[1], 0)]
    spark.createDataFrame(rows, "doc_id long, text string, quality int").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 4 > 0)) for i in range(402)] + [(None, 1), (399, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    train = sorted(((hashlib.md5(str(i).encode()).hexdigest(), texts[i], y) for i, y in labels if i is not None and y is not None and texts[i] is not None and zlib.crc32(str(i).encode()) % 5), key=lambda x: x)
    model = compression.fit([(t, y) for _, t, y in train])
    # every labelled row's own words stand in one dictionary or the other
    assert all(w.encode() in model.good for w in good) and all(w.encode() in model.bad for w in bad)
    got = compression.op10(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)

    def plain(text):
        data, total = text.encode(), 0
        for a in range(0, len(data), compression.BLOCK):
            for raw, sign in ((model.bad, 1), (model.good, -1)):
                total += sign * len(zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False).compress(data[a : a + compression.BLOCK]))
        return total / len(data)

    # the curve's base follows the odds of all labelled rows, those without text included
    odds = lambda ys: math.log(sum(ys) / (len(ys) - sum(ys)))
    base = model.base + odds([y for i, y in labels if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5]) - odds([y for *_, y in train])
    by_id = {r.doc_id: r for r in got}
    for i in [*range(0, 400, 9), 400, 401, 402, 403, 404, None]:
        x, text = by_id[i], texts[1] if i is None else texts[i]
        want = model.prior if not text else 1 / (1 + math.exp(-(model.slope * plain(text) + base)))
        assert x.score == pytest.approx(want, abs=1e-6) and x.predicted == int(x.score >= 0.3)
        assert x.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
    assert by_id[403].score == by_id[0].score
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert compression.op10(spark, str(tmp_path / "none")).count() == 0


# --- context trees ---

def brute_tree(texts, depth):
    """Weighted probabilities by the recursion over contexts, one decision place at a time."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        line = b"\0" * depth + t + b"\0"
        for i in range(depth, len(line)):
            for k in range(8):
                place = (1 << k) | (line[i] >> (8 - k))
                for d in range(depth + 1):
                    counts[line[i - d : i], place][line[i] >> (7 - k) & 1] += 1
    children = defaultdict(list)
    for ctx, place in counts:
        if ctx:
            children[ctx[1:], place].append((ctx, place))

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    weighted = {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(counts[node])
        if len(node[0]) == depth:
            weighted[node] = own
        else:
            below = sum(weighted[c] for c in children[node])
            m = max(own, below)
            weighted[node] = m + math.log(0.5 * math.exp(own - m) + 0.5 * math.exp(below - m))

    def log10(context, byte):
        out = 0.0
        for k in range(8):
            place, bit = (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1
            p = None
            for d in range(depth, -1, -1):
                node = (context[len(context) - d :], place)
                if node not in counts:
                    continue
                n = counts[node]
                here = (n[1] + 0.5) / (sum(n) + 1)
                stop = math.exp(kt(n) + math.log(0.5) - weighted[node])
                p = here if p is None or d == depth else stop * here + (1 - stop) * p
            p = 0.5 if p is None else p
            out += math.log10(p if bit else 1 - p)
        return out

    return log10


@pytest.mark.parametrize("depth", [1, 3])
def test_tree_as_by_the_recursion(depth):
    texts = [b"abracadabra", b"abra cadabra", b"", b"barbara"]
    key, _ = ctw.sequences(pa.array([t.decode() for t in texts]), depth)
    counts = []
    for d in range(depth + 1):
        counts.append(np.unique(key & np.uint64((1 << (8 * d + 8)) - 1), return_counts=True))
    scorer, want = ctw.Scorer(ctw.build(counts)), brute_tree(texts, depth)
    for text in (b"abracadabra", b"cab zoo", b""):
        line = b"\0" * depth + text + b"\0"
        got = scorer.logs(ctw.sequences(pa.array([text.decode()]), depth)[0])
        assert got == pytest.approx([want(line[i - depth : i], line[i]) for i in range(depth, len(line))], abs=1e-4)


def test_chances_of_all_bytes_add_up():
    key, _ = ctw.sequences(pa.array(["the cat sat on the mat " * 5]), 3)
    tree = ctw.build([np.unique(key & np.uint64((1 << (8 * d + 8)) - 1), return_counts=True) for d in range(4)])
    for ctx in (b"the", b"zzz", b" ma", b"\0\0\0"):
        x = np.array([int.from_bytes(ctx, "big") << 8 | b for b in range(256)], np.uint64)
        assert (10 ** ctw.Scorer(tree).logs(x)).sum() == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("most", [1 << 19, 6])
def test_scores(spark, odd, most):
    model = ctw.learn(odd.where("doc_id % 3 <> 0"), "text", depth=3, most_pairs=max(64, most), most_words=most)
    train, rows = odd.where("doc_id % 3 <> 0").collect(), ctw.score(odd, "text", model, ["doc_id", "text"]).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = lambda t: [*WORD.findall((t or "").translate(low)), None]
    c = Counter(w for r in train for w in tokens(r.text))
    total, kinds = sum(c.values()), len(c)
    assert model.n_tokens == total and model.n_kinds == kinds and len(rows) == odd.count()
    for r in rows:
        t = tokens(r.text)
        assert (r.n_tokens, r.n_known) == (len(t), sum(c[w] > 0 for w in t))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t), rel=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0


@pytest.mark.parametrize("most", [1 << 19, 300, 40, 1])
def test_scores_are_of_the_whole_tree_whatever_is_at_hand(spark, monkeypatch, most):
    monkeypatch.setattr(ctw, "PART", 50, raising=False)
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "cat", "sat", "mat", "Ünï", "zebra"]) + str(r.randrange(30)) for _ in range(40)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate([*texts, "a text \u4e2d quite unlike", None, ""])), "doc_id long, text string").repartition(3)
    key, _ = ctw.sequences(pa.array(texts[:20]))
    scorer = ctw.Scorer(ctw.build([np.unique(key & np.uint64((1 << (8 * d + 8)) - 1), return_counts=True) for d in range(ctw.DEPTH + 1)]))
    model = ctw.learn(df.where("doc_id < 20"), "text", most_pairs=most)
    rows = ctw.score(df, "text", model, ["doc_id", "text"]).collect()
    assert len(rows) == 33
    for row in rows:
        want = scorer.logs(ctw.sequences(pa.array([row.text], pa.string()))[0])
        assert row.score == pytest.approx(want.sum(), rel=1e-5)
        assert row.bits_per_byte == pytest.approx(-want.sum() / math.log10(2) / len(want), rel=1e-5)


def test_scores_of_nothing(spark, tmp_path, odd):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert ctw.op2(spark, str(tmp_path)).count() == 0
    model = ctw.learn(odd.limit(0), "text", depth=3)
    out = ctw.score(odd, "text", model, ["doc_id", "text", "n_tokens"])
    assert out.columns == ["doc_id", "text", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]
    for r in out.collect():
        assert r.n_known == 0 and r.bits_per_byte == pytest.approx(8)


def test_held_out_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    for r in df.withColumn("m", common.crc_rest("doc_id", 10)).collect():
        assert r.m == (1 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 10)


def test_shared_files_can_be_released(spark):
    import os

    mark = common.written()
    frames = [common.materialise(spark.range(3), "release") for _ in range(2)]
    paths = common._WRITTEN[mark:]
    assert [f.count() for f in frames] == [3, 3]
    common.release(spark, mark, mark + 1)
    assert not os.path.exists(paths[0]) and os.path.isdir(paths[1]) and common.written() == mark + 1
    common.release(spark, mark)
    assert not os.path.exists(paths[1]) and common.written() == mark
