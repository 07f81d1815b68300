"""TIFF, WARC, mixing, chat formatting and the pipeline."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rivulet.llm import bpe, chat, mixing, queries, tiff, warc

# --- TIFF ---


@pytest.mark.parametrize("compression", sorted(tiff.CODES))
@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("tile", [None, (64, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 256, (5, 192), dtype=np.uint8), np.full((300, 192), 7, np.uint8), np.frombuffer((b"the of and " * 6000)[: 200 * 192], np.uint8).reshape(200, 192), rng.integers(0, 4, (5, 7, 3), dtype=np.uint8)]
    read = tiff.decode_tiff(tiff.encode_tiff(pages, compression, predictor, tile=tile))
    assert [p.data for p in read] == [p.tobytes() for p in pages] and [p.number for p in read] == [0, 1, 2, 3]
    assert all(p.tiled == bool(tile) and p.predictor == 1 + predictor for p in read)


def test_lzw_codes_of_the_specification():
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], 0
    for c in codes:
        bits = bits << 9 | c
    packed = (bits << (-9 * len(codes) % 8)).to_bytes(-(-9 * len(codes) // 8), "big")
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed
    assert tiff.lzw_decode(packed, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_packbits_of_the_specification():
    data = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.packbits_decode(data, len(plain)) == plain and tiff.packbits_decode(tiff.packbits_encode(plain), len(plain)) == plain


def test_big_endian_16_bit_planar():
    image = (np.arange(2 * 3 * 2).reshape(2, 3, 2) * 1000).astype(">u2")
    planes = [np.ascontiguousarray(image[:, :, s]).tobytes() for s in range(2)]
    strips = b"".join(zlib.compress(p) for p in planes)
    sizes = [len(zlib.compress(p)) for p in planes]
    tags = [(256, 3, [3]), (257, 3, [2]), (258, 3, [16, 16]), (259, 3, [8]), (262, 3, [1]), (273, 4, [8, 8 + sizes[0]]), (277, 3, [2]), (278, 3, [2]), (279, 4, sizes), (284, 3, [2])]
    at = 8 + len(strips)
    out, beyond = b"MM\0*" + struct.pack(">I", at) + strips + struct.pack(">H", len(tags)), b""
    end = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(f">{len(values)}{tiff.FORMATS[kind]}", *values)
        out += struct.pack(">HHI", tag, kind, len(values))
        out += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">I", end + len(beyond))
        beyond += raw if len(raw) > 4 else b""
    page = tiff.decode_tiff(out + b"\0\0\0\0" + beyond)[0]
    assert page.data == image.astype("<u2").tobytes() and (page.bits, page.samples) == (16, 2)


def test_tiff_columns(spark):
    texts = [None, "", "short", "é" * 100_000, "a b\n" * 7000, "short"]
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in enumerate(texts)], "doc_id long, text string, media binary, n_bytes int")
    media = tiff.text_media(df, "text", ["doc_id", "text"], rows_per_page=100)
    read = tiff.media_pages(media).collect()
    for r in read:
        raw = (r.text or "").encode()
        whole = b"".join(bytes(p.data) for p in r.pages)
        assert r.n_bytes == len(raw) and whole == tiff.payload(raw) and len(whole) % 192 == 0 and r.media_error is None
        assert len(r.pages) == -(-len(whole) // 19200)
    assert len({bytes(r.media) for r in read if r.text == "short"}) == 1
    assert tiff.explode_pages(tiff.media_pages(media), ["doc_id"]).count() == sum(len(r.pages) for r in read)
    good = tiff.encode_tiff([np.zeros((4, 4), np.uint8)])
    broken = [None, b"", b"II*\0", good[:20], b"II*\0" + b"\xff" * 30, good.replace(b"x", b"y"), good]
    out = tiff.media_pages(spark.createDataFrame([(i, x) for i, x in enumerate(broken)], "id int, media binary")).orderBy("id").collect()
    assert out[0].pages is None and out[0].media_error is None and all(r.pages is None and r.media_error for r in out[1:5]) and out[6].pages[0].width == 4


def test_tiff_query(spark, tmp_path):
    texts = ["", None, "abc", "x" * 400, "ü" * 90_000, "abc", *(f"text {i} " * (1 + 997 * i % 4001) for i in range(60))]
    # ids play no part: null and repeated ones, and columns with a page's names
    rows = [(None if i == 3 else i // 2, t, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, data int").write.parquet(str(tmp_path / "documents.parquet"))
    got = tiff.op7(spark, str(tmp_path)).collect()
    want = Counter()
    layouts = set()
    for d, t, _ in rows:
        raw = (t or "").encode()
        p = tiff.payload(raw)
        layout = tiff.LAYOUTS[zlib.crc32(p) % len(tiff.LAYOUTS)]
        grid = np.frombuffer(p, np.uint8).reshape(-1, 192)
        media = tiff.encode_tiff([grid[y : y + 512] for y in range(0, len(grid), 512)], **layout)
        layouts.add(zlib.crc32(p) % len(tiff.LAYOUTS))
        want[d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest()] += 1
        feature = [r.feature for r in got if r.payload_sha256 == hashlib.sha256(p).hexdigest()][0].split(":")
        assert feature[1].split("+")[0] == layout["compression"] and feature[2] == ("tiles" if "tile" in layout else "strips")
        assert (float(feature[4]), float(feature[5])) == pytest.approx((grid.mean(), grid.std()), abs=1e-3)
    assert Counter(tuple(r)[:7] for r in got) == want and layouts == set(range(len(tiff.LAYOUTS)))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert tiff.op7(spark, str(tmp_path / "none")).count() == 0


def test_malformed_files_fail_no_job(spark):
    rng = np.random.default_rng(1)
    page = rng.integers(0, 9, (40, 192), dtype=np.uint8)
    files = [tiff.encode_tiff([page, page[:7]], **layout) for layout in tiff.LAYOUTS]
    odd = []
    for tag, value in ((tiff.ROWS_PER_STRIP, 0), (tiff.SAMPLES, 0), (tiff.WIDTH, 2**31), (tiff.LENGTH, 2**31), (tiff.WIDTH, 0), (tiff.ROWS_PER_STRIP, 2**31)):
        at = files[0].index(struct.pack("<HH", tag, 4 if tag != tiff.SAMPLES else 3))
        odd.append(files[0][: at + 8] + struct.pack("<I", value) + files[0][at + 12 :])
    for i in range(1200):
        data = bytearray(files[i % len(files)])
        for _ in range(rng.integers(1, 6)):
            k = int(rng.choice([rng.integers(8), rng.integers(len(data)), len(data) - 1 - rng.integers(200)]))
            data[k] = rng.integers(256)
        odd.append(bytes(data[: len(data) - rng.integers(0, 40) * (i % 3 == 0)]))
    df = spark.createDataFrame(list(enumerate(odd)), "id int, media binary").repartition(4)
    out = {r.id: r for r in tiff.media_pages(df).select("id", "media_error", F.size("pages").alias("n")).collect()}
    assert len(out) == len(odd) and all(out[i].media_error for i in range(5))
    assert all((r.media_error is None) == (r.n is not None and r.n >= 0) for r in out.values())


# --- WARC ---

def test_url_keys():
    assert warc.url_key("https://Blog.Example.com:443/a/b?x=1#top") == "com,example,blog)/a/b?x=1"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("no url\n") == "no%20url%0A" and warc.url_key("http://[bad") == "http://[bad"


def test_record_round_trip():
    data = "<p>ü\r\n\r\nWARC/1.0</p>".encode()
    r = warc.parse_record(warc.gzip_member(warc.record(5, "http://a.b/ü\r\nX: y", data, None, False)))
    assert (r["page_id"], r["payload"], r["record_type"], r["payload_bytes"]) == (5, data, "response", len(data)) and "\n" not in r["url"]
    v = warc.parse_record(warc.record(None, None, data, 5, True))
    assert (v["page_id"], v["refers_to"], v["record_type"], v["payload"], v["payload_bytes"], v["payload_digest"]) == (None, 5, "revisit", None, len(data), r["payload_digest"])
    with pytest.raises(ValueError):
        warc.parse_record(warc.record(5, "u", data, None, False).replace(b"<p>", b"<q>"))


@pytest.mark.parametrize("least", [0, 4])
def test_archive(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    r = random.Random(4)
    rows = [(i, f"http://h{r.randrange(4)}.example.com/{r.randrange(30)}", r.choice(["", "abc", "same page", "ü" * 40, f"own {i}"])) for i in range(200)]
    rows += [(300, None, None), (None, "http://h1.example.com/1", "same page"), (301, "odd url", "x"), (5, rows[5][1], rows[5][2]), (None, None, "nobody else")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, first string").repartition(4)
    archive = warc.write_archive(df, "page_id", "url", "html", min_bytes=least)
    read = warc.read_records(warc.lookup(archive, warc.with_key(df, "url", [])), warc.read_tasks(archive)).collect()
    first: dict = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = Counter()
    for p, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= least and (h or "") in first and p != first[h or ""]
        want[(p, len(data), warc.b32_sha1(data), "revisit" if again else "response", first[h or ""] if again else None, None if again else data)] += 1
    assert Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, None if x.payload is None else bytes(x.payload)) for x in read) == want
    one = spark.createDataFrame([("com,example,h1)/1",), ("com,example,none)/",), (None,)], "key string")
    assert Counter(x.page_id for x in warc.lookup(archive, one).collect()) == Counter(p for p, u, _ in rows if warc.url_key(u) in ("com,example,h1)/1", ""))
    parts = archive.parts.collect()
    assert sum(p.lines for p in parts) == len(rows) and any(p.blocks > 1 for p in parts)
    empty = warc.write_archive(df.limit(0), "page_id", "url", "html")
    assert warc.read_records(warc.lookup(empty, one), warc.read_tasks(empty)).count() == 0


# --- mixing ---

def brute_targets(sizes, weights, most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        unit = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if unit * w[s] > most * sizes[s]}
        if not over:
            target |= {s: unit * w[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    r = random.Random(seed)
    share = [40, 1, 1, 3, 2, 8][: r.randrange(2, 7)]
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 3, 9, 50])) or None, r.choices([*"abcdef"[: len(share) - 1], None], share)[0]) for i in range(600)] + [(None, "w w", "a"), (3, "w", "a"), (3, "w", "a")]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, source string, rank string, size int")
    got = mixing.mix_sources(df.repartition(5), "doc_id", "text", "source").collect()
    again = mixing.mix_sources(df.repartition(3), "doc_id", "text", "source").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = brute_targets(sizes, mixing.WEIGHTS), defaultdict(int)
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and x.taken == x.copies * x.size and x.copies <= 3
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 51 for s in want)
    assert mixing.mix_sources(df.limit(0), "doc_id", "text", "source").count() == 0
    kept = mixing.mixed(df, "doc_id", "text", "source")
    words = defaultdict(int)
    for x in kept.collect():
        words[x.source] += len((x.text or "").split())
    assert kept.columns == df.columns and all(abs(words[s] - want[s]) <= 51 for s in want)


# --- chat ---

def brute_chat(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat(spark):
    r = random.Random(2)
    bits = ["### ", "</turn>", "\\", "\n", "\n</turn>\n", "### user\n", "word", "é", " ", "\\\\### ", "$1", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "od\nd\\n", "a: b", "### x"]), "".join(r.choice(bits) for _ in range(r.randrange(9)))) for c in range(120) for t in range(r.randrange(1, 6))]
    rows += [(500, None, "user", None), (500, 1, None, "x"), (500, 1, None, "x"), (None, 0, "assistant", "\n"), (501, 0, "assistant", "</turn>" * 2000 + "\\" * 3001), (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, turns string")
    chats = chat.format_chat(df, "conv_id", "turn", "role", "text")
    got = {x.conv_id: x for x in chat.chat_digests(chats).collect()}
    want = brute_chat(rows)
    assert got.keys() == want.keys() and all((x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == want[c] for c, x in got.items())
    for x in chats.collect():
        assert x.formatted.count("\n</turn>\n") == len(x.turns)
    assert got[-7].escaped_turns == 2 and chat.format_chat(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


# --- queries and pipeline ---

@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables with nulls, repeated rows and near copies."""
    d = tmp_path_factory.mktemp("small")
    r = random.Random(12)
    prose = lambda n: "\n".join(" ".join(r.choice(["the", "of", "and", "a", "to", "is", "in", *(f"{x}{y}{z}" for x in "bdfg" for y in ("an", "er", "ou", "in") for z in ("ing", "ly", "ed", ""))]) for _ in range(15)).capitalize() + "." for _ in range(n))
    docs = [(i, prose(r.randrange(3, 9)), "en", r.choice(["a", "a", "a", "b", None]), 1) for i in range(120)]
    docs += [(200 + i, docs[i][1] + " more", "en", "b", 1) for i in range(0, 30, 3)] + [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "### " * 50, "en", "a", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(i, f"http://a.b/{i % 7}", "x" * (i % 3)) for i in range(30)], "page_id long, url string, html string").write.parquet(str(d / "pages.parquet"))
    spark.createDataFrame([(i // 3, i % 3, ["user", "assistant"][i % 2], f"t{i} \\</turn>") for i in range(30)], "conv_id long, turn long, role string, text string").write.parquet(str(d / "conversations.parquet"))
    return str(d), docs


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_of_queries(spark, small, name):
    d, _ = small
    with duckdb.connect() as db:
        for t in ("documents", "pages", "conversations", "labels"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
        want = db.execute(queries.oracle_sql()[name])
        names = [c[0] for c in want.description]
        rows = want.fetchall()
    got = queries.queries()[name](spark, d).select(*names).collect()
    assert Counter(map(str, map(tuple, got))) == Counter(map(str, rows))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_queries_return_each_document(spark, small, name):
    d, docs = small
    got = queries.queries()[name](spark, d).collect()
    assert Counter(x.doc_id for x in got) == Counter(x[0] for x in docs)


def test_pipeline(spark, small):
    d, docs = small
    texts = {x[0]: x[1] for x in docs}
    frame, ids = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, d).cache()
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids.append(Counter(x.doc_id for x in frame.collect()))
    assert set(range(120)) <= ids[0].keys() and not {300, 301, 302} & ids[0].keys()
    assert len(ids[1]) >= 0.98 * len(ids[0]) and max(ids[2].values()) == 1
    assert not any(200 + i in ids[2] and i in ids[2] for i in range(0, 30, 3))
    assert ids[3].keys() <= ids[2].keys() and max(ids[3].values()) <= 3
    out = corpus_pipeline.run(spark, d).collect()
    assert Counter(x.doc_id for x in out) == ids[3] and all(x.round_trip and len(x.token_ids) == 4 * x.n_tokens for x in out)
    assert all(texts[x.doc_id] for x in out)


def _jaccard_groups(texts):
    """Group of each text by brute force over all pairs of five-word shingle sets."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


def _odd_corpus(odd_ids):
    """Clean and junk texts, copies, nulls, and columns named like what stages make."""
    r = random.Random(29)
    words = {"en": ["the", "of", "and", "to", "in", "is", *(f"{a}{b}ing" for a in "bcdfghlm" for b in "aeiou")], "fr": ["de", "la", "le", "et", "les", "un", *(f"{a}{b}ment" for a in "bcdfghlm" for b in "aéiou")]}
    rows = []
    for i in range(90):
        lang = r.choice(["en", "en", "fr"])
        rows.append((i, " ".join(r.choice(words[lang]) for _ in range(r.randrange(40, 160))), lang, r.choice(["a", "a", "b", None])))
    rows += [(100 + i, rows[i][1] + (" more" if i % 2 else ""), rows[i][2], "c") for i in range(0, 40, 4)]
    rows += [(200, None, "en", "a"), (201, "", "fr", "a"), (202, "### %% " * 40, "en", "b"), (203, "12 " * 60, "en", None), (204, " ".join(str(r.randrange(10**6)) for _ in range(80)), None, "a")]
    if odd_ids:
        rows = [(None if i % 11 == 0 else d // 3, *rest) for i, (d, *rest) in enumerate(rows)] + [rows[1]] * 3
    return [(d, t, la, so, len(t or ""), i, True, "x", 1) for i, (d, t, la, so) in enumerate(rows)]


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, rejected boolean, comp string, copies int"


@pytest.mark.parametrize("odd_ids", [False, True])
def test_pipeline_as_by_brute_force(spark, tmp_path, odd_ids):
    rows = _odd_corpus(odd_ids)
    spark.createDataFrame(rows, ODD_SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    frame, names = spark.read.parquet(str(tmp_path / "documents.parquet")), ODD_SCHEMA.replace(",", "").split()[::2]
    stages, seen = dict(corpus_pipeline.STAGES), rows

    def stage(name):
        nonlocal frame
        frame = stages[name](spark, frame, str(tmp_path)).cache()
        assert frame.columns == names
        return [tuple(x) for x in frame.collect()]

    def duck(sql, documents):
        """sql over documents whose ids are their places."""
        import pandas as pd

        with duckdb.connect() as db:
            db.register("d", pd.DataFrame([(x[5], x[1], x[2], x[3]) for x in documents], columns=["doc_id", "text", "lang", "source"]))
            db.execute("CREATE VIEW documents AS SELECT doc_id, CAST(text AS VARCHAR) AS text, CAST(lang AS VARCHAR) AS lang, CAST(source AS VARCHAR) AS source FROM d")
            got = db.execute(sql)
            return [dict(zip([c[0] for c in got.description], x, strict=True)) for x in got.fetchall()]

    got = stage("quality rules")
    kept = {x["doc_id"] for x in duck(queries.oracle_sql()["op6_quality_rules"], seen) if x["kept"]}
    seen = [x for x in seen if x[5] in kept]
    assert Counter(got) == Counter(seen) and len(seen) >= 90 and not {200, 201, 202} & {x[5] for x in seen}
    got = stage("language ID")
    assert Counter(got) == Counter(x for x in seen if any(c.isalpha() for c in x[1]))
    seen = got
    got = stage("near copies")
    groups = _jaccard_groups([x[1] for x in seen])
    best = {}
    for x, g in zip(seen, groups, strict=True):
        best.setdefault(g, []).append(x)
    of = {x[5]: g for x, g in zip(seen, groups, strict=True)}
    assert Counter(of[x[5]] for x in got) == Counter(dict.fromkeys(best, 1)) and len(best) < len(seen)
    if not odd_ids:
        assert Counter(got) == Counter(min(xs) for xs in best.values())
    seen = got
    got = stage("mix")
    if not odd_ids:
        times = {x["doc_id"]: x["taken"] // x["size"] for x in duck(queries.oracle_sql()["op5_mix_sources"].replace("md5(coalesce(CAST(s.doc_id AS VARCHAR), ''))", f"md5(CAST([{', '.join(str(x[0]) for x in rows)}][s.doc_id + 1] AS VARCHAR))"), seen) if x["size"]}
        assert Counter(got) == Counter({x: times[x[5]] for x in seen if times[x[5]]})
    assert max(Counter(got).values()) <= 3 * max(Counter(x[5] for x in seen).values())
    enc = bpe.encoding(public_tokenizers.path(corpus_pipeline.RANKS), public_tokenizers.PATTERN)
    want = Counter((x[0], x[2], x[3], tuple(enc.encode_ordinary(x[1]))) for x in got)
    out = stages["tokens"](spark, frame, str(tmp_path)).collect()
    assert Counter((x.doc_id, x.lang, x.source, tuple(np.frombuffer(x.token_ids, "<u4").tolist())) for x in out) == want and all(x.round_trip for x in out)
    if not odd_ids:
        whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert Counter((x.doc_id, x.n_tokens) for x in whole) == Counter((x.doc_id, x.n_tokens) for x in out)


def test_pipeline_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_runs_of_backslashes(spark):
    texts = ["\\" * 1_000_000, "\\" * 500_000 + "### x", "\\" * 300_000 + "</turn>" + "\\" * 300_000]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    r = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text").first()
    assert [t["text"] for t in r.turns] == texts
