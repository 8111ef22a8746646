"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

Texts become hashed counts of byte n-grams of their lower-cased letters. A
family is chosen by one-versus-rest machines, a language by votes of the
machines for each pair of languages of that family. Machines always choose, so
whether a text is in any learned language at all is told apart: by the share of
its distinct trigrams that the labelled texts have, with a cut calibrated on
labelled texts that the trigrams were not taken from, and on the same texts with
their letters shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import numbered, pick, struct_udf, texts

#: Hashed features of a text; training texts of each language, about; languages learned, the most frequent ones.
WIDTH, PER_LANGUAGE, LANGUAGES = 1 << 11, 600, 256

#: Hashed trigrams; distinct ones of a text that are too few to tell that it is in no learned language.
TRIGRAMS, TOO_FEW = 1 << 16, 16

#: Where the cut lies, from the share that so many of the shuffled texts stay below, towards the least share of a labelled text.
SHUFFLED, TOWARDS = 0.99, 0.25

UNKNOWN = "und"

_FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn ur mr gu pa ne si",
    "semitic": "ar he mt am",
}
FAMILY = {code: family for family, codes in _FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")
_CLEAR = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def family(lang: str) -> str:
    """By the language's code; a code not listed is a family of its own."""
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def letters(text: str) -> np.ndarray:
    """The bytes of the lower-cased text, all but letters and bytes beyond ASCII as spaces."""
    return np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_CLEAR) + b" ", np.uint8)


def features(raw: np.ndarray) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts, of 2 to 4 bytes, over the whole text."""
    raw = raw.astype(np.uint32)
    counts = np.zeros(WIDTH)
    for n in (2, 3, 4):
        if len(raw) >= n:
            code = raw[: len(raw) - n + 1].copy()
            for k in range(1, n):
                code = code * np.uint32(257) + raw[k : len(raw) - n + 1 + k]
            code = (code + np.uint32(n)) * np.uint32(2654435761)
            counts += np.bincount(code >> np.uint32(21), minlength=WIDTH)
    counts = np.sqrt(counts)
    return (counts / (np.linalg.norm(counts) or 1.0)).astype(np.float32)


def trigrams(raw: np.ndarray) -> np.ndarray:
    """The distinct hashed trigrams, those of spaces alone left out. However often a phrase repeats, it counts once."""
    raw = raw.astype(np.uint32)
    code = (raw[:-2] * np.uint32(257) + raw[1:-1]) * np.uint32(257) + raw[2:]
    code = code[(raw[:-2] != 32) | (raw[1:-1] != 32) | (raw[2:] != 32)]
    there = np.zeros(TRIGRAMS, bool)
    there[((code + np.uint32(7)) * np.uint32(2654435761)) >> np.uint32(16)] = True
    return np.flatnonzero(there).astype(np.uint16)


def shuffled(raw: np.ndarray, seed: int) -> np.ndarray:
    """The same letters and spaces, the letters in random order: in no language, but with the frequencies of one."""
    out = raw.copy()
    at = np.flatnonzero(raw != 32)
    out[at] = np.random.default_rng(seed).permutation(raw[at])
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 100) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, classes weighted alike), the bias last; y is +-1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, momentum = w.copy(), 1.0
    rate = 1.0 / (1.0 + 4.0 * c)  # rows have norm sqrt(2), weights sum to 1
    for _ in range(steps):
        slack = np.maximum(np.float32(0), np.float32(1) - y * (x @ ahead))
        new = ahead - np.float32(rate) * (ahead * np.float32(0.01) - np.float32(2.0 * c) * (x.T @ (weight * y * slack)))
        momentum, last = (1.0 + (1.0 + 4.0 * momentum**2) ** 0.5) / 2.0, momentum
        ahead, w = new + np.float32((last - 1.0) / momentum) * (new - w), new
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    family_weights: np.ndarray = field(default_factory=lambda: np.zeros((0, WIDTH + 1)))
    languages: dict[str, list[str]] = field(default_factory=dict)
    pair_weights: dict[str, np.ndarray] = field(default_factory=dict)
    known: np.ndarray = field(default_factory=lambda: np.zeros(TRIGRAMS, bool))
    cut: float = 0.0

    def recognises(self, raw: np.ndarray) -> bool:
        found = self.known[trigrams(raw)]
        return len(found) < TOO_FEW or float(found.mean()) >= self.cut

    def predict(self, batch: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, whether the text is in a learned language at all) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(batch)
        known = [i for i, t in enumerate(batch) if t and _LETTER.search(t)]
        if not known or not self.families:
            return out
        x, sound = np.ones((len(known), WIDTH + 1), np.float32), []
        for row, i in enumerate(known):
            raw = letters(batch[i])
            x[row, :-1] = features(raw)
            sound.append(self.recognises(raw))
        margins = x @ self.family_weights.T
        best = margins.argmax(axis=1)
        sure = np.ones(len(known))
        if len(self.families) > 1:
            two = np.sort(margins, axis=1)[:, -2:]
            sure = _sigmoid(2.0 * (two[:, 1] - two[:, 0]))
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(best == f)
            langs = self.languages[name]
            votes, strength = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for k, (a, b) in enumerate(combinations(range(len(langs)), 2)):
                m = x[rows] @ self.pair_weights[name][k]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                strength[:, a] += m
                strength[:, b] -= m
            order = votes + _sigmoid(strength) * 0.5  # votes first, then margins
            top = order.argmax(axis=1)
            alone = len(langs) == 1
            own = np.full(len(rows), 60.0) if alone else strength[np.arange(len(rows)), top] / (len(langs) - 1)
            for r, t, p in zip(rows, top, _sigmoid(4.0 * own)):
                out[known[r]] = (langs[t], float(sure[r] * p), sound[r])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def train(x: np.ndarray, langs: list[str]) -> Model:
    """The same model for the same rows in any order of languages; no rows: a model that knows no language."""
    found = sorted(set(langs))
    if not found:
        return Model()
    label = np.array(langs)
    fam = np.array([family(v) for v in langs])
    families = sorted(set(fam))
    if len(families) == 2:
        first = fit_machine(x, np.where(fam == families[0], 1.0, -1.0))
        weights = [first, -first]
    else:
        weights = [fit_machine(x, np.where(fam == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(WIDTH + 1) for f in families]
    model = Model(families, np.array(weights))
    for f in families:
        own = model.languages[f] = [v for v in found if family(v) == f]
        pairs = []
        for a, b in combinations(own, 2):
            rows = (label == a) | (label == b)
            pairs.append(fit_machine(x[rows], np.where(label[rows] == a, 1.0, -1.0)))
        model.pair_weights[f] = np.array(pairs)
    return model


def recognition(texts_of: list[np.ndarray], shuffled_of: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """(trigrams of all texts, cut). Each text, and each shuffled one, is held against the trigrams of the texts of the other half."""
    halves = np.zeros((2, TRIGRAMS), bool)
    for i, own in enumerate(texts_of):
        halves[i % 2, own] = True
    share = lambda found: np.sort([halves[1 - i % 2, own].mean() for i, own in enumerate(found) if len(own) >= TOO_FEW])
    good, bad = share(texts_of), share(shuffled_of)
    if len(good) < 2 or not len(bad):
        return halves.any(axis=0), 0.0
    low, high = float(good[0]), float(np.quantile(bad, SHUFFLED))
    return halves.any(axis=0), min(low, high + TOWARDS * (low - high))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """A model from (doc_id, text, lang): of each of the most frequent languages about ``per_language`` rows, of smallest hash.

    Their product bounds what the driver holds; languages with fewer rows give
    all of theirs. Rows are chosen by a hash of id, text and language, and rows
    alike count once, so neither repeated ids nor null ids break the bound. Rows
    without a letter teach nothing.
    """
    rows = pick(labelled, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not found:
        return Model()
    shares = {r["lang"]: min(1.0, per_language / r["count"]) for r in found}
    least = labelled.sparkSession.createDataFrame([(k, int((1 << 30) * v) + 1) for k, v in sorted(shares.items())], "known string, below bigint")
    place = F.pmod(F.xxhash64("doc_id", "text", "lang"), F.lit(1 << 30))
    chosen = rows.join(F.broadcast(least), (F.col("lang") == F.col("known")) & (place < F.col("below"))).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for lang, t in zip(b.column("lang").to_pylist(), texts(b.column("text"))):
                if t and _LETTER.search(t):
                    raw = letters(t)
                    held.append((lang, features(raw).astype(np.float16).tobytes(), trigrams(raw).tobytes(), trigrams(shuffled(raw, zlib.crc32(raw.tobytes()))).tobytes()))
            columns = list(zip(*held)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["lang", "x", "own", "other"])

    sample = chosen.mapInArrow(run, "lang string, x binary, own binary, other binary").distinct().toArrow()
    sample = sample.sort_by([("lang", "ascending"), ("x", "ascending"), ("own", "ascending")])
    if not sample.num_rows:
        return Model()
    x = np.stack([np.frombuffer(v.as_py(), np.float16) for v in sample.column("x")]).astype(np.float32)
    model = train(x, sample.column("lang").to_pylist())
    model.known, model.cut = recognition(*([np.frombuffer(v.as_py(), np.uint16) for v in sample.column(c)] for c in ("own", "other")))
    return model


def _predictor(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: Iterable[str | None]) -> Iterator[tuple]:
        held: list[str | None] = []
        for text in batch:
            held.append(text)
            if len(held) == 256:
                yield from shared.value.predict(held)
                held = []
        yield from shared.value.predict(held)

    return struct_udf({"lang": "string", "score": "double", "recognised": "boolean"}, rows)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents, by crc32 of the id's digits, that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, recognised) of each row's whole text.

    Without a model, one is fitted to the rows with a language that are not held
    out. ``und`` with score 0: the text is null or has no letter, or no language
    could be learned. ``recognised`` is false for these, and for texts too few
    of whose trigrams the labelled texts have; very short ones are. A null id is not held out.
    Repeated rows each give a row; an empty table gives none; other columns are
    ignored.
    """
    if model is None:
        rows = pick(docs, "doc_id", "text", "lang")
        model = fit(rows.where(~held_out()))
    found = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), _predictor(docs, model)("text").alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.recognised")


def keep_known(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents in a language that is recognised, columns as they are."""
    if model is None:
        model = fit(pick(docs, "doc_id", "text", "lang").where(~held_out()))
    frame, col, back = numbered(docs)
    return back(frame.where(_predictor(docs, model)(col("text"))["recognised"]))
