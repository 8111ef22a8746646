"""Quality by an isolation forest over rule statistics.

Every document gets rule statistics of its whole text, once. Trees of random
splits are grown on a bounded sample of labelled rows; a document that few splits
isolate is an anomaly. For each band of lengths, the cut is calibrated from the
scores of all good and all bad rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import array_udf, cut, pick, struct_udf

#: Trees, rows that each is grown on, labelled rows that the driver holds at most (about).
TREES, ROWS_PER_TREE, SAMPLE = 200, 256, 20_000

#: How many shares of lost good rows weigh as much as one of missed bad rows; rows of either kind a band needs for a cut of its own; bins of scores.
LOSS_WEIGHT, BAND_ROWS, BINS = 4.0, 10, 1 << 13

#: Words up to which a band reaches.
BANDS = (50, 200, 1000)

#: Base rules: fewest words, greatest percentage of words in repeated windows, words in a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5

_SPACE = "\x20\t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_SYMBOL_BYTES = [ord(c) for c in _SYMBOLS]

FEATURES = ("word_len", "symbols", "repeats", "capitals", "exclaims", "top_word")


def repeated_words(code: np.ndarray, distinct: int) -> int:
    """Words in five-word windows that occur at least twice, the first occurrence included. ``code``: a number for each word."""
    n = len(code)
    if n <= WINDOW or distinct == n:
        return 0
    if distinct**WINDOW < 1 << 62:
        key = np.zeros(n - WINDOW + 1, np.int64)
        for k in range(WINDOW):
            key = key * distinct + code[k : n - WINDOW + 1 + k]
    else:  # too many words for one number: exact in steps, each pair of numbers replaced by its rank
        two = np.unique(code[:-1] * distinct + code[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
        key = four[:-1].astype(np.int64) * distinct + code[WINDOW - 1 :]
    sorted_keys = np.sort(key)
    if not (sorted_keys[1:] == sorted_keys[:-1]).any():
        return 0
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    edge = np.zeros(n + 1, np.int64)
    starts = np.union1d(order[1:][same], order[:-1][same])
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge)[:n] > 0).sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the forest's features."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # at ASCII white space only
    n = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spaces = int(count[[32, 9, 10, 11, 12, 13]].sum())
    chars = len(text) - spaces
    symbols = int(count[_SYMBOL_BYTES].sum())
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeated = repeated_words(code, len(ids))
    if not n:
        return (0, chars, symbols, dup, 0), [0.0] * len(FEATURES)
    row = [
        float(np.log1p(chars / n)),
        symbols / max(1, chars),
        repeated / n,
        float(count[65:91].sum()) / max(1, chars),
        float(count[33]) / n,
        (int(np.bincount(code).max()) - 1) / n,
    ]
    return (n, chars, symbols, dup, repeated), row


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def band(n_words: Column) -> Column:
    """0 to len(BANDS)."""
    return sum(((n_words > b).cast("int") for b in BANDS), F.lit(0))


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        found = 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, found, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees side by side: (trees, nodes); node k has the children 2k+1 and 2k+2; a leaf has feature -1."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    norm: float
    cuts: np.ndarray = field(default_factory=lambda: np.full(len(BANDS) + 1, np.inf))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1: 2 ** -(mean path length / expected)."""
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))[None, :]
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                f = self.feature[trees, node]
                right = part[rows, np.maximum(f, 0)] >= self.split[trees, node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            out[i : i + 256] = 2.0 ** (-self.path[trees, node].mean(axis=1) / self.norm)
        return out

    @property
    def depth(self) -> int:
        return (self.feature.shape[1] + 1).bit_length() - 2


def grow(x: np.ndarray, seed: int = 5, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(rows_per_tree, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    nodes = (1 << (depth + 1)) - 1
    feature, split, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        todo = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
        while todo:
            node, level, rows = todo.pop()
            low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
            able = np.flatnonzero(high > low)
            if level == depth or len(rows) < 2 or not len(able):
                path[t, node] = level + float(_average_path(np.array(len(rows))))
                continue
            f = int(rng.choice(able))
            s = rng.uniform(low[f], high[f])
            feature[t, node], split[t, node] = f, s
            right = rows[:, f] >= s
            todo += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return Forest(feature, split, path, float(_average_path(np.array(max(2, size)))))


def calibrate(forest: Forest, bins: np.ndarray) -> Forest:
    """For each band, the cut with the least weighted sum of lost good and missed bad rows; all rows serve a band with few of its own.

    ``bins[band, good, bin]``: labelled rows by score.
    """
    for k, own in enumerate(bins):
        forest.cuts[k] = best_cut(*(own if own.sum(axis=1).min() >= BAND_ROWS else bins.sum(axis=0)))
    return forest


def best_cut(bad: np.ndarray, good: np.ndarray) -> float:
    """Halfway from the best bin to the next one with rows; without bad or good rows, nothing is rejected."""
    if not bad.sum() or not good.sum():
        return float("inf")
    lost, missed = 1.0 - np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    k = int(np.argmin(missed + LOSS_WEIGHT * lost))
    beyond = np.flatnonzero((good + bad)[k + 1 :])
    return (2 * k + 2 + (beyond[0] if len(beyond) else 0)) / (2 * len(bad))


_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, x) of each row's whole text; x: the forest's features."""

    def rows(batch: Iterable[str | None]) -> Iterator[tuple]:
        for text in batch:
            numbers, x = statistics(text)
            yield *numbers, base_failed(numbers[0], numbers[4]), x

    found = struct_udf({k: "bigint" for k in _NUMBERS} | {"base_failed": "boolean", "x": "array<double>"}, rows)
    return pick(docs, "doc_id", "text").select("doc_id", found("text").alias("q")).select("doc_id", F.col("q.*"))


def _score(spark: SparkSession, forest: Forest):
    shared = spark.sparkContext.broadcast(forest)

    def run(batch: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)))

    return array_udf("double", run)


def fit(found: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """A forest from the ``described`` rows that ``labels`` (doc_id, quality) has; None if it has none.

    Trees grow on about ``sample`` of these rows, of smallest hash of all that
    they hold, rows alike once: neither repeated ids nor repeated rows break that
    bound of what the driver holds. The cuts are calibrated on all of them, by
    counts of binned scores. Rows without id or quality take no part; of several
    qualities for an id the least counts.
    """
    known = pick(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    rows = cut(found.join(known.hint("rebalance"), "doc_id").select("doc_id", "n_words", "base_failed", "x", "good"))
    n = rows.count()
    if not n:
        return None
    place = F.pmod(F.xxhash64("doc_id", "n_words", "x"), F.lit(1 << 30))
    held = rows.where(place < int((1 << 30) * min(1.0, sample / n)) + 1).select("doc_id", "x").distinct().toArrow()
    forest = grow(np.array([x for _, x in sorted(zip(held.column("doc_id").to_pylist(), held.column("x").to_pylist()))]))
    at = F.least(F.floor(_score(found.sparkSession, forest)("x") * BINS), F.lit(BINS - 1))
    counted = rows.where(~F.col("base_failed")).groupBy(band(F.col("n_words")).alias("band"), F.col("good").cast("int").alias("good"), at.alias("at"))
    bins = np.zeros((len(BANDS) + 1, 2, BINS))
    for r in counted.count().collect():
        bins[r["band"], r["good"], r["at"]] = r["count"]
    return calibrate(forest, bins)


def judge(docs: DataFrame, labels: DataFrame, forest: Forest | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) of each row.

    ``kept`` is false where the base rules fail or the forest's score is over
    the band's cut; without labelled rows to calibrate from, the base rules
    alone decide (score 0). A null text has no words. Repeated rows each give a
    row; an empty table gives none; other columns are ignored.
    """
    found = described(docs)
    if forest is None:
        found = cut(found)
        forest = fit(found, labels)
    score = _score(docs.sparkSession, forest)("x") if forest else F.lit(0.0)
    found = found.withColumn("score", score)
    cuts = F.lit(float("inf"))
    for k, most in enumerate(forest.cuts if forest else ()):
        cuts = F.when(band(F.col("n_words")) == k, F.lit(float(most))).otherwise(cuts)
    return found.select("doc_id", *_NUMBERS, "base_failed", (~F.col("base_failed") & (F.col("score") <= cuts)).alias("kept"), "score")
