"""SimHash near-duplicates: fingerprints over word shingles, pivot distance tables, distributed components.

Two plans share one engine. ``EXACT`` links 64-bit fingerprints of four-word
shingles that differ in at most 4 bits and loses no link: with six blocks of
bits or more, two such fingerprints agree on enough blocks to share a key.
``similar()`` links texts whose distinct five-word shingles have a Jaccard
similarity of 0.8 or more. Fingerprints of such texts differ in some 15 % of
their bits, too many for blocks. So texts meet in buckets of MinHash keys, a
fixed number for each text whatever the corpus (``recall``), and only key and
node travel; fingerprints are fetched once for what shares a bucket, and rule
out pairs. What they leave only proposes: within each group that the proposals
connect, the shingles themselves are compared, and what they confirm is linked.

Within the fingerprints of one key, distances to fixed reference fingerprints
rule out pairs by their greatest coordinate difference (triangle inequality)
and the rest are compared bit by bit. No pair within a dense group is ever
emitted but those of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import array_udf, cut, numbered, pick, texts

#: Up to this many fingerprints of one key are compared offset by offset; more go through leaders.
PAIRWISE = 512

#: A key with more distinct fingerprints than this is dealt to several tasks: of the exact plan, of the similarity plan.
SLICE, SIMILAR_SLICE = 1 << 15, 1 << 13

#: MinHash keys of a text, least hashes that make up each.
BANDS, LEAST = 32, 4

#: Fingerprints of fewer shingles than this rule out nothing in the similarity plan: their bits differ by chance.
FEW = 64

#: Reference fingerprints of the pivot table, of up to eight words of 64 bits.
PIVOTS = np.random.default_rng(64).integers(0, 1 << 64, (16, 8), dtype=np.uint64)

#: A proposed group is compared in slices of up to this many texts and characters; smaller ones, from ``SPREAD`` texts on, in up to eight slices, so that they spread over tasks.
TEXTS, CHARACTERS, SPREAD = 1024, 1 << 24, 32

_FULL = (1 << 64) - 1


def block_keys(n: int, radius: int = 4) -> list[int]:
    """Bit masks, of which two 64-bit fingerprints within ``radius`` agree on one at least.

    With b blocks, at most ``radius`` of them differ, so the other b - radius
    agree. More blocks make more keys, of more bits: chosen so that few
    unrelated fingerprints share one.
    """
    blocks = 6 if n <= 1 << 24 else 7 if n <= 1 << 31 else 8
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    return [sum(c) for c in combinations(bits, blocks - radius)]


def differing(similarity: float) -> float:
    """Expected share of differing bits of texts whose shingles have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def recall(similarity: float, bands: int = BANDS, least: int = LEAST) -> float:
    """Share of the pairs of this Jaccard similarity that meet in a bucket: all but 5e-8 of them at 0.8, all but 2e-11 at 0.85."""
    return 1 - (1 - similarity**least) ** bands


@dataclass(frozen=True)
class Plan:
    """Words of a shingle, 64-bit words of a fingerprint, and differing bits that still link (exact) or propose.

    With a ``similarity``, fingerprints are of distinct shingles and only propose links, which the shingles must confirm.
    """

    shingle: int
    words: int
    radius: int
    similarity: float | None = None

    @property
    def columns(self) -> list[str]:
        return [f"f{i}" for i in range(self.words)]


EXACT = Plan(4, 1, 4)


def similar(shingle: int = 5, similarity: float = 0.8, words: int = 4) -> Plan:
    """Links of this similarity, whose shingles are compared.

    Bits rule out pairs only beyond 6 standard deviations more than such links
    differ in: one link in a thousand million.
    """
    share = differing(similarity)
    radius = math.floor(64 * words * share + 6 * math.sqrt(64 * words * share * (1 - share)))
    return Plan(shingle, words, radius, similarity)


_TO_SPACE = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle in order. Beside the text, eight bytes a word are held, and Python objects of a part at a time."""
    norm = (text or "").encode("utf-8", "replace").lower().translate(_TO_SPACE).strip(b" ")
    while b"  " in norm:
        norm = norm.replace(b"  ", b" ")
    if not norm:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    digest = xxhash.xxh64_intdigest
    if len(gaps) + 1 < shingle:
        return np.array([digest(norm, 42)], np.uint64)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(norm)]])[shingle - 1 :]
    out = np.empty(len(ends), np.uint64)
    for i in range(0, len(ends), 1 << 14):
        part = slice(i, i + (1 << 14))
        out[part] = [digest(norm[a:b], 42) for a, b in zip(starts[part].tolist(), ends[part].tolist())]
    return out


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th further word of a shingle's hash."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(i * 0x9E3779B97F4A7C15 & _FULL)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = 4, words: int = 1, distinct: bool = False) -> int:
    """Unsigned; no words in the text: zero; fewer than a shingle: the whole sequence is one.

    A bit is 1 if set in over half of the shingles' hashes, repeats included
    unless ``distinct``. Beyond 64 bits, each hash is mixed into further ones.
    """
    hashes = _hashes(text, shingle)
    return _voted(np.unique(hashes) if distinct else hashes, words)


def _voted(hashes: np.ndarray, words: int) -> int:
    n = 64 * words
    counts = np.zeros(n, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # bounded, however long the text
        part = hashes[i : i + (1 << 14)]
        wide = np.stack([part, *(_mixed(part, w) for w in range(1, words))], axis=1).astype("<u8")
        counts += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


_TURNS = np.random.default_rng(128).integers(0, 1 << 31, BANDS * LEAST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the least of the hashes in LEAST random orders."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * LEAST, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 1 << 12):  # bounded, however long the text
        np.minimum(least, (short[i : i + (1 << 12), None] * _TURNS[None, :]).min(axis=0), out=least)
    two = least.view("<u8").reshape(BANDS, LEAST // 2)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in two.T:
        key = _mixed(key ^ column, 1)
    return key


def fingerprints(plan: Plan):
    """An Arrow UDF: text to the words of its fingerprint.

    With a similarity, also ``node``, a hash of the distinct shingles, their
    number ``size``, and the bucket keys ``k0``, ....
    """
    alike = plan.similarity is not None
    names = [*plan.columns, *(["node", "size", *(f"k{i}" for i in range(BANDS))] if alike else [])]

    def run(batch: pa.Array) -> pa.Array:
        found = np.zeros((len(batch), len(names)), "<u8")
        for i, t in enumerate(texts(batch)):
            hashes = _hashes(t, plan.shingle)
            if alike:
                hashes = np.unique(hashes)
                found[i, plan.words : plan.words + 2] = xxhash.xxh64_intdigest(hashes.tobytes(), 7), len(hashes)
                found[i, plan.words + 2 :] = bucket_keys(hashes)
            found[i, : plan.words] = np.frombuffer(_voted(hashes, plan.words).to_bytes(8 * plan.words, "little"), "<u8")
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, w]).view(np.int64)) for w in range(len(names))], names)

    return array_udf("struct<" + ",".join(f"{c}:bigint" for c in names) + ">", run)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, their words along the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def verified(f: np.ndarray, near: np.ndarray, left: np.ndarray, right: np.ndarray, plan: Plan, size: np.ndarray) -> np.ndarray:
    """Which pairs (left, right) of rows of f are linked, or proposed. ``near``: the pivot table, a row for each reference fingerprint.

    With a similarity, sizes alone rule out some pairs, and bits nothing of texts with few shingles.
    """
    at, few = np.arange(len(left)), np.zeros(0, np.int64)
    if plan.similarity is not None:
        less, more = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
        at = np.flatnonzero(less >= plan.similarity * more)
        few, at = at[less[at] < FEW], at[less[at] >= FEW]
    for row in near:
        at = at[np.abs(row[left[at]] - row[right[at]]) <= plan.radius]
        if not len(at):
            return few
    at = at[distance(f[left[at]], f[right[at]]) <= plan.radius]
    return np.concatenate([few, at]) if len(few) else at


def pivot_table(f: np.ndarray) -> np.ndarray:
    """Fewer reference fingerprints for longer ones, whose radius is wide: they rule out little there."""
    return np.stack([distance(f, p[: f.shape[1]]) for p in PIVOTS[: len(PIVOTS) // f.shape[1]]])


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return root


def dense_links(both: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect a large group of fingerprints as all its links would.

    Leaders are picked until each member is within the radius of one. Balls
    are then joined where a member of one is linked to a member of another;
    distances to the leaders rule out most comparisons.
    """
    leaders: list[int] = []
    ball = np.full(len(both), -1)
    left = np.arange(len(both))
    links: list[tuple[int, int]] = []
    while len(left):
        lead = left[0]
        close = distance(both[left], both[lead]) <= radius
        ball[left[close]] = len(leaders)
        links += [(int(i), int(lead)) for i in left[close][1:]]
        leaders.append(int(lead))
        left = left[~close]
    parent = list(range(len(leaders)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tops = np.arange(len(leaders))
    for k, lead in enumerate(leaders):
        reach = distance(both, both[lead])
        mine = np.flatnonzero(ball == k)
        own = reach[mine]
        while True:
            others = np.flatnonzero((reach <= 2 * radius) & (tops[ball] != tops[k]) & (ball != k))
            found = None
            for i in range(0, len(others), 1 << 12):
                part = others[i : i + (1 << 12)]
                for j in range(0, len(mine), 1 << 9):
                    some = mine[j : j + (1 << 9)]
                    maybe = np.abs(reach[part][:, None] - own[None, j : j + (1 << 9)]) <= radius
                    a, b = np.nonzero(maybe)
                    hit = np.flatnonzero(distance(both[part[a]], both[some[b]]) <= radius)
                    if len(hit):
                        found = part[a[hit]], some[b[hit]]
                        break
                if found is not None:
                    break
            if found is None:
                break
            for x, y in zip(*found):
                s, t = top(int(ball[x])), top(k)
                if s != t:
                    links.append((int(x), int(y)))
                    parent[max(s, t)] = min(s, t)
            tops = np.array([top(x) for x in range(len(leaders))])
    return links


def chained_links(f: np.ndarray, plan: Plan, size: np.ndarray) -> list[tuple[int, int]]:
    """Proposals that connect a large group as all its proposals would, whatever they are: no pair of one component is compared again."""
    order = np.argsort(size, kind="stable")
    f, size = f[order], size[order]
    near, label = pivot_table(f), np.arange(len(f))
    ends = np.searchsorted(size, size / plan.similarity, "right")
    pairs: list[tuple[int, int]] = []
    for i, end in enumerate(ends):
        at = np.flatnonzero(label[i + 1 : end] != label[i]) + i + 1
        if not len(at):
            continue
        hit = at[verified(f, near, np.full(len(at), i), at, plan, size)]
        if len(hit):
            met, first = np.unique(label[hit], return_index=True)
            pairs += [(int(order[j]), int(order[i])) for j in hit[first]]
            label[np.isin(label, met)] = label[i]
    return pairs


def _edges_of(key: np.ndarray, node: np.ndarray, f: np.ndarray, size: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of the same key, as (node, node of its local root)."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    lefts, rights = [], []
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= PAIRWISE), sizes))
    if len(at):
        k, x, n = key[at], f[at], size[at]
        near = pivot_table(x)
        i, off = np.arange(len(k)), 1
        while len(i := i[i + off < len(k)]) and len(i := i[k[i] == k[i + off]]):
            hit = verified(x, near, i, i + off, plan, n)
            lefts.append(at[i[hit]])
            rights.append(at[i[hit] + off])
            off += 1
    for s, n in zip(starts[sizes > PAIRWISE], sizes[sizes > PAIRWISE]):
        own = slice(s, s + n)
        if pairs := dense_links(f[own], plan.radius) if plan.similarity is None else chained_links(f[own], plan, size[own]):
            found = np.array(pairs) + s
            lefts.append(found[:, 0])
            rights.append(found[:, 1])
    if not sum(map(len, lefts)):
        return node[:0], node[:0]
    nodes, code = np.unique(node[np.concatenate([*lefts, *rights])], return_inverse=True)
    half = len(code) // 2
    root = forest(len(nodes), code[:half], code[half:])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _find_links(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, size, f0, ...), or (key, f0), come sorted by key; the last key of a batch waits for the next one."""

    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        u, v = _edges_of(*(np.concatenate(x) for x in zip(*parts)), plan)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        k, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(k):
            continue
        node, size = (rest[0], rest[0]) if plan.similarity is None else rest[:2]
        x = np.stack(rest[-plan.words :], axis=1).view(np.uint64)
        last = int(np.searchsorted(k, k[-1]))
        if last or not held or held[-1][0][0] != k[-1]:
            done = [*held, (k[:last], node[:last], x[:last], size[:last])]
            held = []
            if sum(len(p[0]) for p in done):
                yield out(done)
        held.append((k[last:], node[last:], x[last:], size[last:]))
    if held:
        yield out(held)


def _cells(s: Column, node: str) -> Column:
    """The pairs (a, b), a <= b, of ``s`` slices that a node is in, when it is dealt to one of them by hash: every two nodes meet in one."""
    own = F.pmod(F.xxhash64(node, F.lit(7)), s).cast("int")
    return F.transform(F.sequence(F.lit(0), s - 1), lambda j: F.struct(F.least(j, own).alias("a"), F.greatest(j, own).alias("b")))


def links(distinct: DataFrame, n: int, slice_size: int = SLICE) -> DataFrame:
    """(u, v): links over n distinct fingerprints in column f0, with the components of all links that share a key.

    A key that more than ``slice_size`` fingerprints share is cut into slices by
    hash, and each pair of slices becomes a key of its own, so no task holds
    more than two slices and no link is lost.
    """
    keys = [F.xxhash64(F.lit(i), F.col("f0").bitwiseAND(F.lit(_signed(mask)))) for i, mask in enumerate(block_keys(n))]
    keyed = distinct.select(F.explode(F.array(*keys)).alias("key"), "f0")
    if n > slice_size:
        crowded = keyed.groupBy("key").count().where(F.col("count") > slice_size).select("key", F.ceil(F.col("count") / slice_size).cast("int").alias("s"))
        joined = keyed.join(crowded, "key", "left")
        cells = joined.where(F.col("s").isNotNull()).select("key", "f0", F.explode(_cells(F.col("s"), "f0")).alias("p"))
        keyed = joined.where(F.col("s").isNull()).select("key", "f0").unionByName(cells.select(F.xxhash64("key", "p.a", "p.b").alias("key"), "f0"))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _find_links(batches, EXACT), "u bigint, v bigint")


def proposals(nodes: DataFrame, plan: Plan, slice_size: int = SIMILAR_SLICE) -> DataFrame:
    """(u, v): proposed links over distinct (node, size, f0, ..., k0, ...), with the components of all proposals that share a bucket.

    Only (key, node) is shuffled for all buckets. Those of one node go, of those
    with the same nodes one stays, and the fingerprints are joined to the rest.
    Buckets of more than ``slice_size`` nodes are cut into slices as in ``links``.
    """
    keyed = nodes.where(F.col("size") > 0).select(F.explode(F.array(*(f"k{i}" for i in range(BANDS)))).alias("key"), "node")
    mark = [F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node", F.lit(3))).alias("mark")]
    shared = keyed.groupBy("key").agg(*mark).where(F.col("n") > 1)
    shared = cut(shared.groupBy("n", "low", "high", "mark").agg(F.min("key").alias("key")))
    two = shared.where(F.col("n") == 2).select("key", "n", F.explode(F.array("low", "high")).alias("node"))
    more = keyed.join(shared.where(F.col("n") > 2).select("key", "n").hint("rebalance"), "key").select("key", "n", "node")
    held = two.unionByName(more).join(nodes.select("node", "size", *plan.columns), "node")
    s = F.ceil(F.col("n") / slice_size).cast("int")
    cells = held.select(F.explode(_cells(s, "node")).alias("p"), "key", "n", "node", "size", *plan.columns)
    key = F.when(F.col("n") > slice_size, F.xxhash64("key", "p.a", "p.b")).otherwise(F.col("key")).alias("key")
    parts = cells.select(key, "node", "size", *plan.columns).repartition("key").sortWithinPartitions("key")
    return parts.mapInArrow(lambda batches: _find_links(batches, plan), "u bigint, v bigint")


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node it reaches.

    Alternating large-star and small-star steps, each a minimum by key and a
    join, until nothing changes; each step cuts its lineage with a checkpoint.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    now = cut(edges.where(F.col("u") != F.col("v")).select(high.alias("u"), low.alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least.hint("rebalance"), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def similar_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect non-empty sets as all pairs of this Jaccard similarity would: no pair of one component is compared again."""
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = code.ravel()
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(code), bool)
    root = np.arange(len(sets))
    links: list[tuple[int, int]] = []
    for i in range(len(sets) - 1):
        rest = sizes[i + 1 :]
        at = np.flatnonzero((root[i + 1 :] != root[i]) & (np.minimum(rest, sizes[i]) / np.maximum(rest, sizes[i]) >= similarity)) + i + 1
        if not len(at):
            continue
        own = code[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        if 4 * len(at) > len(rest):
            common = np.add.reduceat(mark[code[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)[at - i - 1]
        else:
            common = np.array([np.count_nonzero(mark[code[starts[j] : starts[j] + sizes[j]]]) for j in at])
        mark[own] = False
        for j in at[common / (sizes[at] + sizes[i] - common) >= similarity]:
            if root[j] != root[i]:
                links.append((int(j), i))
                root[root == max(root[i], root[j])] = min(root[i], root[j])
    return links


def _confirm(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, text) come sorted by key; the links (u, v) of each key's texts."""
    key, held = None, {}

    def out() -> pa.RecordBatch:
        nodes = [n for n, s in held.items() if len(s)]
        found = similar_sets([held[n] for n in nodes], similarity) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    for b in batches:
        for k, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
            if k != key:
                if len(held) > 1:
                    yield out()
                key, held = k, {}
            if node not in held:
                held[node] = np.unique(_hashes(text, shingle))
    if len(held) > 1:
        yield out()


def confirmed(docs: DataFrame, narrow: DataFrame, proposed: DataFrame, plan: Plan) -> DataFrame:
    """(u, v): links of texts that are as similar as the plan asks, within each group of ``proposed`` (node, root).

    Slices, and keys for their pairs, are as in ``links``: every pair of a group
    meets in some task, however large the group is.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "length")).alias("row")
    grouped = narrow.groupBy("node").agg(first).join(proposed.select("node", "root").hint("rebalance"), "node").select("node", "root", "row.*")
    sizes = grouped.groupBy("root").agg(F.count("*").alias("n"), F.sum("length").alias("length"))
    s = F.greatest(F.ceil(F.col("n") / TEXTS), F.ceil(F.col("length") / CHARACTERS), F.least(F.lit(8), F.ceil(F.col("n") / SPREAD)))
    sizes = sizes.select("root", F.least(s, F.col("n")).cast("int").alias("s"))
    wanted = cut(grouped.select("node", "doc_id", "text_key", "root").join(sizes.hint("rebalance"), "root").select("node", "doc_id", "text_key", "root", "s"))
    rows = pick(docs, "doc_id", "text").withColumnsRenamed({"doc_id": "k_id"}).withColumn("k_text", F.xxhash64("text"))
    found = rows.join(wanted, rows["k_id"].eqNullSafe(wanted["doc_id"]) & (rows["k_text"] == wanted["text_key"]))
    cells = found.select("root", "node", "text", F.explode(_cells(F.col("s"), "node")).alias("p")).select(F.xxhash64("root", "p.a", "p.b").alias("key"), "node", "text")
    shingle, similarity = plan.shingle, plan.similarity
    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _confirm(batches, shingle, similarity), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, plan: Plan = EXACT, slice_size: int | None = None) -> DataFrame:
    """(doc_id, f0, node, text_key, component_id) for each row: the smallest doc_id that links lead to.

    A null text has no words, so its fingerprint is zero and it is linked to
    every text without words. Repeated rows each give a row. Null ids belong to
    their component but never name it, unless it has no other (then null). An
    empty table gives no rows; other columns are ignored. ``text_key`` is a hash
    of the text, to find the row again. With a similarity, ``node`` stands for
    the distinct shingles, links are those that they confirm, and there is no f0.
    """
    found = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_key"), F.length("text").alias("length"), fingerprints(plan)("text").alias("f"))
    narrow = found.select("doc_id", "text_key", "length", "f.*")
    if plan.similarity is None:
        narrow = cut(narrow.drop("length").withColumn("node", F.col("f0")))
        distinct = cut(narrow.groupBy("node", "f0").agg(F.min("doc_id").alias("rep")))
        stars = components(links(distinct, distinct.count(), slice_size or SLICE))
    else:
        narrow = cut(narrow)
        distinct = cut(narrow.groupBy("node", "size", *plan.columns, *(f"k{i}" for i in range(BANDS))).agg(F.min("doc_id").alias("rep")))
        narrow = narrow.select("doc_id", "text_key", "length", "node")
        proposed = components(proposals(distinct, plan, slice_size or SIMILAR_SLICE))
        stars = components(confirmed(docs, narrow, proposed, plan))
        narrow, distinct = narrow.drop("length"), distinct.select("node", "rep")
    least = distinct.select(F.col("node").alias("n"), "rep")
    linked = cut(stars.join(least, stars["node"] == least["n"]).select("node", "root", "rep"))
    named = linked.groupBy("root").agg(F.min("rep").alias("component_id")).hint("rebalance")
    moved = linked.join(named, "root").select("node", "component_id")
    alone = distinct.join(moved, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    return narrow.join(alone.hint("rebalance"), "node")


def fingerprint_hex(column: str = "f0") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The documents, one of each component: the row of its smallest doc_id (a null id only where there is no other).

    Unless told otherwise, distinct five-word shingles and a similarity of 0.8. Of rows
    that repeat the id and text that stay, one stays. Columns are kept as they are.
    """
    found = near_duplicates(docs, plan or similar())
    no_id = F.col("doc_id").isNull()
    first = F.min(F.struct(no_id.alias("no_id"), "doc_id", "text_key")).alias("first")
    group = F.coalesce(F.col("component_id"), F.col("node"))
    keep = found.groupBy(F.col("component_id").isNull().alias("unnamed"), group.alias("g")).agg(first).select("first.doc_id", "first.text_key").hint("rebalance")
    frame, col, back = numbered(docs)
    keyed = frame.withColumns({"k_id": col("doc_id"), "k_text": F.xxhash64(col("text"))})
    kept = keyed.join(keep, keyed["k_id"].eqNullSafe(keep["doc_id"]) & (keyed["k_text"] == keep["text_key"]), "left_semi")
    turn = F.row_number().over(Window.partitionBy("k_id", "k_text").orderBy("k_id"))
    return back(kept.withColumn("turn", turn).where(F.col("turn") == 1))
