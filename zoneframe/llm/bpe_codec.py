"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, at places where a match of the splitting
pattern ends whatever stands around them, so the ids are those of the whole
text while one call into the library stays small. A very long run of white
space, on which the library's pattern engine would fail, is one match less its
last character, and goes to the merges alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import array_udf, pick, struct_udf, texts

#: Texts beyond this many characters are encoded in pieces of about this size.
PIECE_CHARS = 1 << 16

# A match of the pattern holds white space only at its start, or is white space
# alone: before white space that follows another character, a match always ends.
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])")

#: White space in a run that goes to the merges without the pattern.
SPACE_RUN = 1 << 14

# White space as the pattern engine has it.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in order, in pieces that end at safe boundaries.

    A text without such a boundary after ``size`` characters stays whole from
    there to the next one.
    """
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    """The text in order, in pieces of bounded size; True: a run of white space that the merges take alone."""
    if len(text) <= PIECE_CHARS:
        yield text, False
        return
    done = 0
    for run in re.finditer(f"{_SPACE}{{{SPACE_RUN},}}", text):
        # Before other text, its last character is not part of the match.
        end = run.end() - (run.end() < len(text))
        yield from ((piece, False) for piece in pieces(text[done : run.start()]))
        if end > run.start():
            yield text[run.start() : end], True
        done = end
    yield from ((piece, False) for piece in pieces(text[done:]))


def encode(text: str, encoding: tiktoken.Encoding) -> list[int]:
    ids: list[int] = []
    for part, alone in _parts(text):
        ids += encoding._encode_single_piece(part) if alone else encoding.encode_ordinary(part)
    return ids


def encode_array(text: str, encoding: tiktoken.Encoding, end: int) -> np.ndarray:
    """The same ids and then ``end``, as unsigned 32-bit numbers, without a list of them."""
    found = [np.array(encoding._encode_single_piece(part), "<u4") if alone else encoding.encode_to_numpy(part, disallowed_special=()) for part, alone in _parts(text)]
    return np.concatenate([*found, [end]], dtype="<u4", casting="unsafe")


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text; null and empty texts give an empty array.

    Repeated rows each give a row; an empty table gives none; other columns take no part.
    """

    def run(batch: pa.Array) -> pa.Array:
        encoding = codec(rank_file, pattern)
        return pa.array([encode(t or "", encoding) for t in texts(batch)], pa.list_(pa.int32()))

    return pick(docs, "doc_id", "text").select("doc_id", array_udf("array<int>", run)("text").alias("ids"))


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) of each row's ids; raw bytes, since ids may be cut inside a character. Null ids give none."""

    def run(batch: pa.Array) -> pa.Array:
        encoding = codec(rank_file, pattern)
        return pa.array([encoding.decode_bytes(ids.as_py() or []) for ids in batch], pa.binary())

    return pick(encoded, "doc_id", "ids").select("doc_id", array_udf("binary", run)("ids").alias("bytes"))


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text, encoded and decoded in one pass.

    Null and empty texts have no tokens and the digests of nothing. Rows repeat
    as they do in the table; an empty table gives no rows; other columns are ignored.
    """

    def rows(batch: Iterable[str | None]) -> Iterator[tuple]:
        encoding = codec(rank_file, pattern)
        names = _decimal(encoding.max_token_value)
        for text in batch:
            ids = encode(text or "", encoding)
            shown = b" ".join([names[i] for i in ids])
            yield len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(encoding.decode_bytes(ids)).hexdigest()

    digest = struct_udf({"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, rows)
    return pick(docs, "doc_id", "text").select("doc_id", digest("text").alias("d")).select("doc_id", F.col("d.*"))


@lru_cache(maxsize=4)
def _decimal(most: int) -> list[bytes]:
    return [str(i).encode() for i in range(most + 1)]
