"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut beforehand at boundaries that no match of the pre-splitting pattern
spans, so the ids are those of the whole text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import map_slices, texts

#: Texts of more code points are cut into parts of about this many.
PART = 1 << 16
#: White space after a letter or digit: a match never goes on over it, and what stands
#: before it is not white space, so no look-ahead sees the cut either.
_CUT = regex.compile(r"(?<=[\p{L}\p{N}])(?=\p{White_Space})")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> list[str]:
    """text in pieces of about size code points, cut only at safe boundaries."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def _part_ids(enc: tiktoken.Encoding, part: str, pattern: str) -> np.ndarray:
    if len(part) <= 4 * PART:
        return enc.encode_to_numpy(part, disallowed_special=())
    # no safe boundary for long: match by match, so that no regex engine's limit is met
    split = regex.compile(pattern)
    return np.fromiter((i for m in split.finditer(part) for i in enc._encode_single_piece(m[0])), np.uint32)


def encode_text(text: str, ranks_path: str, pattern: str, size: int = PART) -> np.ndarray:
    """The ids of a whole text as unsigned 32-bit integers."""
    enc = encoding(ranks_path, pattern)
    ids = [_part_ids(enc, p, pattern) for p in parts(text, size)]
    return (ids[0] if len(ids) == 1 else np.concatenate(ids)).astype("<u4", copy=False)


def decode_ids(ids: np.ndarray, ranks_path: str, pattern: str) -> bytes:
    """The raw bytes that ids stand for; they need not be UTF-8."""
    return encoding(ranks_path, pattern).decode_bytes(ids.tolist())


def encode(df: DataFrame, text: str, ranks_path: str, pattern: str, keep: list[str] | None = None, decode: bool = False) -> DataFrame:
    """Adds token_ids (binary: little-endian unsigned 32-bit ids), n_tokens and, if asked for, decoded (binary).

    A null or empty text has no ids. Text is never normalised, so decoded equals the
    text's UTF-8 bytes. Existing columns of these names are replaced; repeated rows
    are encoded alike; an empty table gives an empty one.
    """
    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("decoded", T.BinaryType())] * decode

    def make():
        def fn(array: pa.Array) -> list:
            ids = [encode_text(t, ranks_path, pattern) for t in texts(array)]
            out = [[x.tobytes() for x in ids], [len(x) for x in ids]]
            return out + ([[decode_ids(x, ranks_path, pattern) for x in ids]] if decode else [])

        return fn

    return map_slices(df, text, fields, make, keep)


def decode(df: DataFrame, token_ids: str, ranks_path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Adds decoded (binary) of a packed id column; null ids decode to no bytes."""
    def make():
        return lambda array: [[decode_ids(np.frombuffer(x or b"", "<u4"), ranks_path, pattern) for x in array.to_pylist()]]

    return map_slices(df, token_ids, [T.StructField("decoded", T.BinaryType())], make, keep)


def token_digests(df: DataFrame, text: str, ranks_path: str, pattern: str, keep: list[str]) -> DataFrame:
    """keep, n_tokens and SHA-256 digests of the packed ids and of the decoded bytes; columns of keep with these names are replaced."""
    keep = [c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    out = encode(df, text, ranks_path, pattern, keep, decode=True)
    return out.select(*(F.col(f"`{c}`") for c in keep), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
