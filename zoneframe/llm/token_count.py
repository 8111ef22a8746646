"""Token counts with a whole-token shortcut.

A vocabulary string that the library encodes alone as one token is proven once
per worker. Pre-tokens found among these strings count one each; only the
other pre-tokens, each distinct one once per batch, go through the merges.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import pick, struct_udf

#: Token counts over this set ``over_limit``.
LIMIT = 2048

#: Counts of merged pre-tokens that a worker remembers before it starts anew; texts whose pre-tokens are looked up together.
REMEMBERED, TOGETHER = 1 << 20, 64

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

# As the vocabulary file splits: contractions, runs of letters, single digits, runs of the rest.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", regex.V1)

# Characters on whose class or lower case Unicode versions differ, the one whose
# lower case ends in a mark, which may have to change places with the next one,
# and all beyond the basic plane: texts that hold one are left to the library as a whole.
_UNSURE = regex.compile(
    r"[\u0130\u0530\u0557\u0558\u058b-\u0590\u0870-\u08ff\u0c5c-\u0c5f\u0cdc-\u0cdf\u1c80-\u1c8f\u208f\u209d-\u209f"
    r"\ua7c0-\ua7ff\uab6a-\uab6f\U00010000-\U0010ffff]"
)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """Strings that are one pre-token and that the library encodes alone as one token."""
    library = tokenizer(path)
    chars = _byte_of_char()
    found = []
    for token in library.get_vocab(with_added_tokens=False):
        if token.endswith("</w>") and all(c in chars for c in token[:-4]):
            try:
                found.append(bytes(chars[c] for c in token[:-4]).decode())
            except UnicodeDecodeError:
                continue
    found = [w for w in found if _SPLIT.findall(w) == [w] and _plain(w) and lowered(w) == w]
    encoded = library.encode_batch_fast(found, add_special_tokens=False)
    return frozenset(w for w, e in zip(found, encoded, strict=True) if len(e) == 1)


def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in the file, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain(text: str) -> bool:
    """Whether splitting here is known to agree with the library."""
    return text.isascii() or (not _UNSURE.search(text) and unicodedata.is_normalized("NFC", text))


def lowered(text: str) -> str:
    """Character by character: a final sigma is not treated apart."""
    return text.replace("Σ", "σ").lower()


class Counting:
    """Counts for one worker."""

    def __init__(self, path: str) -> None:
        self.library = tokenizer(path)
        self.whole = whole_tokens(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known = dict.fromkeys(self.whole, 1)

    def counts(self, batch: Iterable[str | None]) -> Iterator[int]:
        held: list[str] = []
        for text in batch:
            held.append(text or "")
            if len(held) == TOGETHER:
                yield from self._together(held)
                held = []
        yield from self._together(held)

    def count(self, text: str) -> int:
        return next(self._together([text]))

    def _together(self, batch: list[str]) -> Iterator[int]:
        by_library = [any(s in t for s in self.special) or not _plain(t) for t in batch]
        words = [[] if odd else _SPLIT.findall(lowered(t)) for t, odd in zip(batch, by_library)]
        if len(self.known) > REMEMBERED:
            self.known = dict.fromkeys(self.whole, 1)
        if new := list(set().union(*words).difference(self.known)):
            encoded = self.library.encode_batch_fast(new, add_special_tokens=False)
            self.known.update((w, len(e)) for w, e in zip(new, encoded, strict=True))
        for text, own, odd in zip(batch, words, by_library):
            yield len(self.library.encode(text, add_special_tokens=False)) if odd else sum(map(self.known.__getitem__, own))


@lru_cache(maxsize=2)
def counting(path: str) -> Counting:
    return Counting(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text.

    Special strings inside a text are single tokens, as the library has it by
    default. Null texts count as empty; repeated rows each give a row; an empty
    table gives none; other columns are ignored.
    """

    def rows(batch: Iterable[str | None]) -> Iterator[tuple]:
        return ((n,) for n in counting(path).counts(batch))

    counted = pick(docs, "doc_id", "text").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        struct_udf({"n": "bigint"}, rows)("text").alias("t"),
    )
    return counted.select("doc_id", "n_bytes", F.col("t.n").alias("n_tokens"), (F.col("t.n") > limit).alias("over_limit"))
