"""Packing along a space-filling curve: neighbouring documents share sequences, and almost nothing is padded.

A document's token ids are hashed into a vector, projected to ``DIMS``
dimensions and placed on a Hilbert curve. Documents, in the order of their
keys, form one long stream of ids that is cut every ``SEQUENCE`` ids. The last
cut, if short, is split into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import cut, pick, texts
from .bpe_codec import encode_array

#: Ids in a full sequence; the id that ends a document.
SEQUENCE, END = 1024, 0

#: Dimensions of the curve, bits of each, width of the hashed vectors.
DIMS, BITS, WIDTH = 4, 12, 256

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def projection(width: int = WIDTH, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(4).standard_normal((width, dims))


class Ids:
    """The ids of the vocabulary file, as its own library gives them.

    The same ranks in tiktoken give the same ids for every code point, several
    times as fast. Texts that hold an added token's string go to the library,
    which sees that token in them.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.added = [t["content"] for t in held["added_tokens"]]
        ranks = {bytes(chars[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in self.added}
        self.fast = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)

    def of(self, text: str) -> np.ndarray:
        """The ids of a text and its end id."""
        if any(a in text for a in self.added):
            return np.array([*self.library.encode(text, add_special_tokens=False).ids, END], "<u4")
        return encode_array(text, self.fast, END)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of integer points (n, dims), each in [0, 2**bits): the transpose form, undone bit by bit."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Keys of hashed count vectors. The scale is fixed, so a document's key doesn't depend on the others."""
    flat = np.sqrt(vectors) - np.sqrt(vectors).mean(axis=1, keepdims=True)
    norm = np.linalg.norm(flat, axis=1, keepdims=True)
    at = np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0) @ projection()
    return hilbert(np.clip(((np.tanh(at) + 1) / 2 * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64))


def _hashed(ids: np.ndarray) -> np.ndarray:
    return np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=WIDTH).astype(np.float64)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(uid, doc_id, hkey, n, ids): ids as compressed little-endian unsigned 32-bit, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                counts, packed, vectors = [], [], []
                for text in texts(part.column("text")):
                    own = ids.of(text or "")
                    counts.append(len(own))
                    packed.append(compress(own))
                    vectors.append(_hashed(own))
                keys = curve_keys(np.stack(vectors))
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("doc_id"), pa.array(keys), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                    ["uid", "doc_id", "hkey", "n", "ids"],
                )

    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "uid bigint, doc_id bigint, hkey bigint, n bigint, ids binary")


def compress(ids: np.ndarray) -> bytes:
    """Two bytes an id where all fit, then zstd; the first byte tells which."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if small else b"\4") + len(ids).to_bytes(8, "little") + pa.compress(ids.astype("<u2" if small else "<u4").tobytes(), codec="zstd", asbytes=True)


def expand(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:9], "little")
    raw = pa.decompress(packed[9:], width * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")


def offsets(light: DataFrame) -> DataFrame:
    """(uid, at): each document's first place in the stream, by (hkey, hash of uid).

    The rows are range-sorted into partitions; running sums within each, plus
    the total of the partitions before it, give the places. Rows with one key
    (copies) are spread over partitions by the hash. Only one total for each
    partition meets in one task and on the driver.
    """
    ranged = light.select("uid", "hkey", "n", F.xxhash64("uid").alias("h")).repartitionByRange("hkey", "h", "uid")
    dealt = cut(ranged.sortWithinPartitions("hkey", "h", "uid").select("uid", "n", F.spark_partition_id().alias("part")))
    slices = dealt.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = slices.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    bases = {r["part"]: r["base"] for r in base.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for b in batches:
            if b.num_rows:
                n = b.column("n").to_numpy()
                ends = np.cumsum(n) + (bases[b.column("part")[0].as_py()] if done is None else done)
                done = ends[-1]
                yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(ends - n)], ["uid", "at"])

    return dealt.mapInArrow(run, "uid bigint, at bigint")


def cuts(at: int, n: int, total: int, size: int = SEQUENCE) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence_id, offset) of the pieces of a document of n ids that begins at ``at``.

    Full sequences are numbered along the stream. The rest, after the last full
    one, is cut into powers of two, greatest first, each a sequence of its own.
    """
    full = total // size
    bounds, place = [], full * size
    left = total - place
    while left:
        bit = 1 << (left.bit_length() - 1)
        bounds.append((place, bit))
        place += bit
        left -= bit
    start = 0
    while start < n:
        here = at + start
        if here < full * size:
            seq, first, width = here // size, here // size * size, size
        else:
            k = max(i for i, (p, _) in enumerate(bounds) if p <= here)
            seq, (first, width) = full + k, bounds[k]
        length = min(n - start, first + width - here)
        yield start, length, seq, here - first
        start += length


PIECES = {
    "doc_id": pa.int64(),
    "start": pa.int64(),
    "length": pa.int64(),
    "ids_crc32": pa.int64(),
    "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(),
    "offset": pa.int64(),
}


def pack_documents(docs: DataFrame, path: str, size: int = SEQUENCE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of the table is a document, repeated rows and null ids included; a
    null or empty text is its end id alone. An empty table gives no pieces;
    other columns are ignored. ``size`` must be a power of two.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    held = cut(tokenized(docs, path))
    places = offsets(held.select("uid", "hkey", "n"))
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list[int | None]] = [[] for _ in PIECES]
            for doc_id, n, at, packed in zip(*(b.column(c) for c in ("doc_id", "n", "at", "ids"))):
                ids, tokens, place = expand(packed.as_py()), n.as_py(), at.as_py()
                for start, length, seq, offset in cuts(place, tokens, total, size):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for c, v in zip(columns, (doc_id.as_py(), start, length, crc, tokens, seq, offset)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECES.values())], list(PIECES))

    joined = held.select("uid", "doc_id", "n", "ids").join(places, "uid").select("doc_id", "n", "at", "ids")
    return joined.mapInArrow(run, ", ".join(f"`{c}` bigint" for c in PIECES))
