"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import public_tokenizers as P
import tiktoken
import xxhash
from tokenizers import Tokenizer

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@lru_cache
def tiktoken_encoding():
    lines = open(P.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("brute", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def library(name):
    return Tokenizer.from_file(P.path(name))


def op1(text):
    ids = tiktoken_encoding().encode_ordinary(text or "")
    return len(ids), sha(" ".join(map(str, ids))), sha(text or "")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius=4):
    """For each place, the smallest place that links lead to."""
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def op2(rows):
    """{(doc_id, fingerprint, component)} of (doc_id, text) rows, as a sorted list."""
    fps = [fingerprint(t) for _, t in rows]
    group = classes(fps)
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, f"{f:016x}", least.get(g)) for (i, _), f, g in zip(rows, fps, group)]


def op3_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 5))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def op4(rows, every=20, k=20):
    import math

    fit = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fit if i % every == 0}):
        own = min(v for i, v in fit if i == q)
        scored = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in fit if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def op5(rows):
    """(doc_id, n_lines, n_removed, text) of (doc_id, text) rows with distinct non-null ids."""
    seen, cut = set(), {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n") if t is not None else []
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if any(WORD.search(x) for x in w):
                if w in seen:
                    cut.setdefault(i, set()).update((k, k + 1, k + 2))
                seen.add(w)
    return [(i, 0 if t is None else t.count("\n") + 1, len(cut.get(i, ())), t if i not in cut else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[i])) for i, t in rows]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def op7_base(text):
    found = []
    for kind, rx in [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ]:
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }
            if good[kind]:
                found.append((kind, m.start(), m.end()))
    return found


def op8(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for action, rule in RULES:
        domain, _, tail = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best[1] if best else None, best[0] if best else None


def op9(text):
    n = len(library("word_bpe_49k.json").encode(text or "", add_special_tokens=False).ids)
    return len((text or "").encode()), n, n > 2048


def ids10(text):
    return [*library("byte_bpe_50k.json").encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, pieces, size=1024):
    """Pieces (doc_id, start, length, crc, doc_tokens, sequence_id, offset) hold each id once; sequences are gapless and full or a power of two."""
    import struct
    import zlib
    from collections import Counter, defaultdict

    want, got, sequences = Counter(), defaultdict(list), defaultdict(list)
    for doc, text in rows:
        want[doc, len(ids10(text))] += 1
    ids = defaultdict(list)  # several texts may have one id and one length
    for doc, text in rows:
        ids[doc, len(ids10(text))].append(ids10(text))
    for doc, start, length, crc, tokens, seq, offset in pieces:
        own = [i[start : start + length] for i in ids[doc, tokens]]
        assert length >= 1 and any(len(i) == length and crc == zlib.crc32(struct.pack(f"<{length}I", *i)) for i in own)
        got[doc, tokens].append((start, length))
        sequences[seq].append((offset, length))
    for key, times in want.items():
        cover = Counter(i for start, length in got.pop(key) for i in range(start, start + length))
        assert set(cover) == set(range(key[1])) and set(cover.values()) == {times}
    assert not got
    short = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size and at & (at - 1) == 0
        short += at < size
    assert short <= size.bit_length()
