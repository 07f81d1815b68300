"""TIFF media columns: write samples as TIFF files, walk files and decode each page.

Reads classic TIFF of either byte order with any number of image directories; strips or
tiles; no compression, PackBits, LZW or deflate; horizontal-differencing predictor;
1 to 4 samples of 8 or 16 bits a pixel, chunky or planar.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import map_slices, table

# Fixed values of the format: tags, field types and compression codes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODES = {"none": NONE, "lzw": LZW, "deflate": ADOBE_DEFLATE, "packbits": PACKBITS}
NAMES = {v: k for k, v in CODES.items()} | {DEFLATE: "deflate"}
#: Bytes that a byte of a strip can stand for at most, by the densest codec, and bytes of a file's decoded pages: a row's column holds no more.
MOST_DENSE, MOST_DECODED = 4096, (1 << 31) - (1 << 20)


class TiffError(ValueError):
    """The file isn't a TIFF that this module reads."""


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    chunks: int
    #: Decoded samples, row by row, little-endian if of 16 bits.
    data: bytes


# --- codecs -------------------------------------------------------------------------------

def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out[:size])


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more as runs, what stands between them as it is."""
    out, n = bytearray(), len(data)
    if not n:
        return b""
    a = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    runs = np.diff(np.append(starts, n))
    long = runs > 2
    at = 0
    for s, r in [*zip(starts[long].tolist(), runs[long].tolist(), strict=True), (n, 0)]:
        for k in range(at, s, 128):
            part = data[k : min(k + 128, s)]
            out.append(len(part) - 1)
            out += part
        at = s + r
        while r:
            k = min(r, 128)
            out += bytes((257 - k, data[s])) if k > 1 else bytes((0, data[s]))
            r -= k
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    known, out, total, prev = list(base), [], 0, None
    hold = bits = 0
    width, at = 9, 0
    while total < size:
        while bits < width:
            if at >= len(data):
                return b"".join(out)[:size]
            hold = (hold << 8) | data[at]
            at += 1
            bits += 8
        bits -= width
        code = (hold >> bits) & ((1 << width) - 1)
        hold &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            known, width, prev = list(base), 9, None
            continue
        if code < len(known):
            entry = known[code]
        elif prev is not None and code == len(known):
            entry = prev + prev[:1]
        else:
            raise TiffError("bad LZW code")
        out.append(entry)
        total += len(entry)
        if prev is not None:
            known.append(prev + entry[:1])
        prev = entry
        if len(known) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    out, hold, bits = bytearray(), 0, 0

    def put(code: int, width: int):
        nonlocal hold, bits
        hold, bits = (hold << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((hold >> bits) & 255)
            hold &= (1 << bits) - 1

    base = {bytes((i,)): i for i in range(256)}
    known, following, width, word = dict(base), 258, 9, b""
    put(256, 9)
    for b in data:
        longer = word + bytes((b,))
        if longer in known:
            word = longer
            continue
        put(known[word], width)
        known[longer] = following
        following += 1
        if following == 4094:
            put(256, width)
            known, following, width = dict(base), 258, 9
        elif following + 1 > (1 << width) - 1 + 1 and width < 12:
            width += 1
        word = bytes((b,))
    if word:
        put(known[word], width)
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((hold << (8 - bits)) & 255)
    return bytes(out)


def _compress(raw: bytes, code: int, level: int) -> bytes:
    if code == NONE:
        return raw
    if code == PACKBITS:
        return packbits_encode(raw)
    return lzw_encode(raw) if code == LZW else zlib.compress(raw, level)


def _expand(data: bytes, code: int, size: int) -> bytes:
    if code == NONE:
        return data[:size]
    if code == PACKBITS:
        return packbits_decode(data, size)
    if code == LZW:
        return lzw_decode(data, size)
    if code in (ADOBE_DEFLATE, DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise TiffError(f"compression {code} isn't read")


# --- writing ------------------------------------------------------------------------------

def encode_tiff(pages: list[np.ndarray], compression: str = "deflate", predictor: bool = False, rows_per_strip: int = 64, tile: tuple[int, int] | None = None, level: int = 1) -> bytes:
    """A little-endian TIFF of 8-bit pages, arrays of (height, width) or (height, width, samples)."""
    code, out, link = CODES[compression], bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        h, w, s = page.shape
        if tile:
            tw, th = tile
            padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), np.uint8)
            padded[:h, :w] = page
            chunks = [padded[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            chunks = [page[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        offsets, counts = [], []
        for c in chunks:
            if predictor:
                d = c.copy()
                d[:, 1:] -= c[:, :-1]
                c = d
            data = _compress(np.ascontiguousarray(c).tobytes(), code, level)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags = [(WIDTH, 4, [w]), (LENGTH, 4, [h]), (BITS, 3, [8] * s), (COMPRESSION, 3, [code]), (PHOTOMETRIC, 3, [2 if s >= 3 else 1]), (SAMPLES, 3, [s]), (PLANAR, 3, [1])]
        tags += [(PREDICTOR, 3, [2])] * predictor
        tags += [(TILE_WIDTH, 4, [tile[0]]), (TILE_LENGTH, 4, [tile[1]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        directory, at = struct.pack("<H", len(tags)), len(out) + 2 + 12 * len(tags) + 4
        beyond = b""
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{FORMATS[kind]}", *values)
            directory += struct.pack("<HHI", tag, kind, len(values))
            if len(raw) <= 4:
                directory += raw.ljust(4, b"\0")
            else:
                directory += struct.pack("<I", at + len(beyond))
                beyond += raw + b"\0" * (len(raw) % 2)
        link = len(out) + len(directory)
        out += directory + b"\0\0\0\0" + beyond
    return bytes(out)


# --- reading ------------------------------------------------------------------------------

def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    if at + 2 > len(data):
        raise TiffError("directory beyond the file's end")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise TiffError("directory beyond the file's end")
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = SIZES.get(kind, 0) * count
        place = at + 2 + 12 * i + 8
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if kind in FORMATS and place + size <= len(data):
            tags[tag] = list(struct.unpack_from(f"{order}{count}{FORMATS[kind]}", data, place))
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _page(data: bytes, tags: dict[int, list[int]], number: int, order: str, left: int) -> Page:
    """left: bytes that the page may have decoded."""
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    w, h, s, bits = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
    if w < 1 or h < 1 or s < 1 or bits not in (8, 16) or set(tags.get(BITS, [bits])) != {bits}:
        raise TiffError("image without size or samples, or samples of other than 8 or 16 bits")
    code, predictor, planar = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if predictor not in (1, 2):
        raise TiffError(f"predictor {predictor} isn't read")
    tiled = TILE_OFFSETS in tags
    cw, ch = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    if (cw or 0) < 1 or (ch or 0) < 1:
        raise TiffError("strips or tiles without size")
    offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, [])
    across, down = -(-w // cw), -(-h // ch)
    planes, deep = (s, 1) if planar == 2 else (1, s)
    if len(offsets) != across * down * planes or len(counts) != len(offsets):
        raise TiffError("strips or tiles are missing")
    if w * h * s * bits // 8 > min(left, MOST_DENSE * (len(data) + 1)):
        raise TiffError("image larger than its strips or tiles can hold")
    kind = np.dtype(order + f"u{bits // 8}")
    image = np.empty((h, w, s), f"<u{bits // 8}")
    for i, (o, c) in enumerate(zip(offsets, counts, strict=True)):
        plane, y, x = i // (across * down), i % (across * down) // across * ch, i % across * cw
        rows = ch if tiled else min(ch, h - y)
        size = rows * cw * deep * bits // 8
        raw = _expand(data[o : o + c], code, size)
        if len(raw) < size:
            raise TiffError("strip or tile is too short")
        chunk = np.frombuffer(raw, kind).reshape(rows, cw, deep)
        if predictor == 2:
            chunk = np.cumsum(chunk, axis=1, dtype=chunk.dtype.newbyteorder("="))
        part = chunk[: h - y, : w - x]
        if planes > 1:
            image[y : y + rows, x : x + cw, plane] = part[:, :, 0]
        else:
            image[y : y + rows, x : x + cw] = part
    return Page(number, w, h, s, bits, code, predictor, tiled, len(offsets), image.tobytes())


def decode_tiff(data: bytes) -> list[Page]:
    """Every page of a file, in the directories' order; a loop of directories ends at its start.

    Pages of more than MOST_DECODED bytes together are an error: no row could hold them.
    """
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    (at,), seen, pages, left = struct.unpack_from(order + "I", data, 4), set(), [], MOST_DECODED
    while at and at not in seen:
        seen.add(at)
        tags, following = _directory(data, at, order)
        pages.append(_page(data, tags, len(pages), order, left))
        left -= len(pages[-1].data)
        at = following
    return pages


# --- columns ------------------------------------------------------------------------------

PAGE = "array<struct<page:int,width:int,height:int,samples:int,bits:int,compression:int,predictor:int,tiled:boolean,chunks:int,data:binary>>"
WIDE, ROWS_A_PAGE = 192, 512
#: How files are laid out, by the checksum of what they hold: each codec, strips and tiles, with and without predictor.
LAYOUTS = (
    {"compression": "deflate", "predictor": True},
    {"compression": "lzw", "rows_per_strip": 32},
    {"compression": "packbits", "rows_per_strip": 16},
    {"compression": "deflate", "tile": (64, 32)},
    {"compression": "packbits", "predictor": True, "tile": (96, 64)},
    {"compression": "deflate", "predictor": True, "tile": (128, 16)},
    {"compression": "none", "rows_per_strip": 128},
    {"compression": "deflate"},
)


def payload(text: bytes, multiple: int = WIDE) -> bytes:
    """text and spaces up to a positive multiple of multiple."""
    return text.ljust(max(1, -(-len(text) // multiple)) * multiple, b" ")


def text_media(df: DataFrame, text: str, keep: list[str] | None = None, layouts: tuple[dict, ...] = LAYOUTS, rows_per_page: int = ROWS_A_PAGE) -> DataFrame:
    """Adds media (binary: a TIFF of the padded text's bytes, 192 samples a row, 512 rows a page) and n_bytes.

    The layout goes by the checksum of the bytes, so equal texts make equal files. Null
    and empty texts: n_bytes 0, one row of spaces. Long texts make more pages; a text whose
    file would pass 2 GiB can't stand in a row. Columns of these names are replaced,
    repeated rows made alike; an empty table stays empty.
    """
    def make():
        def fn(array: pa.Array) -> list:
            raws = [(x or "").encode() for x in array.to_pylist()]
            media = []
            for raw in raws:
                data = payload(raw)
                grid = np.frombuffer(data, np.uint8).reshape(-1, WIDE)
                media.append(encode_tiff([grid[y : y + rows_per_page] for y in range(0, len(grid), rows_per_page)], **layouts[zlib.crc32(data) % len(layouts)]))
            return [media, [len(r) for r in raws]]

        return fn

    return map_slices(df, text, [T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())], make, keep)


def media_pages(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Adds pages (an array of structs, data: the decoded samples) and media_error.

    Null media: null pages, no error. A file that can't be read, whatever is wrong with
    it: null pages and what went wrong; the job goes on. Columns of these names are
    replaced; an empty table stays empty. explode_pages() gives a row for each page.
    """
    kind = T._parse_datatype_string(f"pages {PAGE}")[0].dataType

    def make():
        def fn(array: pa.Array) -> list:
            pages, errors = [], []
            for data in array.to_pylist():
                try:
                    found = None if data is None else [[p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.chunks, p.data] for p in decode_tiff(data)]
                    pages.append(found and [dict(zip(names, p, strict=True)) for p in found])
                    errors.append(None)
                except Exception as e:  # one file's fault, of any kind: bytes from anywhere are read here
                    pages.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            return [pages, errors]

        return fn

    names = kind.elementType.fieldNames()
    return map_slices(df, media, [T.StructField("pages", kind), T.StructField("media_error", T.StringType())], make, keep)


def explode_pages(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each page of each file, a file's pages next to each other and in order; files without pages give none. Of keep, columns with a page field's name are left out."""
    fields = T._parse_datatype_string(f"pages {PAGE}")[0].dataType.elementType.fieldNames()
    kept = [F.col(f"`{c}`") for c in keep if c not in fields]
    return df.select(*kept, F.explode("pages").alias("__page")).select(*kept, "__page.*")


def page_digests(pages: DataFrame, keep: list[str]) -> DataFrame:
    """explode_pages()' rows, as they come -> one row a file: keep, and of its pages' samples one after another payload_bytes, payload_sha256, tail_crc32 (of the last 16) and feature.

    feature: codec, strips or tiles, pages, the last page's size, mean and deviation of
    all samples. A page numbered 0 begins a file, so no id is needed and nothing is
    shuffled; a file's pages are folded as they come and never held together.
    """
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType())])
    columns = ["page", "width", "height", "compression", "predictor", "tiled", "data"]
    from pyspark.sql.pandas.types import to_arrow_schema

    target, width = to_arrow_schema(schema), len(keep)

    def fold(batches):
        rows, now = [], None

        def done():
            n, total, squares = now["n"], now["sum"], now["squares"]
            mean = total / n
            feature = f"tiff:{NAMES[now['code']]}{'+diff' * (now['predictor'] == 2)}:{'tiles' if now['tiled'] else 'strips'}:{now['pages']}x{now['width']}x{now['height']}:{mean:.4f}:{max(0.0, squares / n - mean * mean) ** 0.5:.4f}"
            rows.append([*now["keep"], n, now["hash"].hexdigest(), zlib.crc32(now["tail"]), feature])

        def out():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)
            rows.clear()
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                r = [batch.column(j)[i].as_py() for j in range(batch.num_columns)]
                p = dict(zip(columns, r[width:], strict=True))
                if p["page"] == 0:
                    if now:
                        done()
                    now = {"keep": r[:width], "n": 0, "sum": 0, "squares": 0, "tail": b"", "hash": hashlib.sha256(), "pages": 0}
                samples = np.frombuffer(p["data"], np.uint8).astype(np.int64)
                now["n"] += len(samples)
                now["sum"] += int(samples.sum())
                now["squares"] += int((samples * samples).sum())
                now["tail"] = (now["tail"] + p["data"][-16:])[-16:]
                now["hash"].update(p["data"])
                now["pages"] += 1
                now |= {"width": p["width"], "height": p["height"], "code": p["compression"], "predictor": p["predictor"], "tiled": p["tiled"]}
            if rows:
                yield out()
        if now:
            done()
            yield out()

    return pages.select(*(F.col(f"`{c}`") for c in keep), *columns).mapInArrow(fold, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    made = text_media(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])
    made = made.select("doc_id", "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    keep = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    out = page_digests(explode_pages(media_pages(made, "media", keep), keep), keep)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
