"""Problem 6: near-duplicate records with small edits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendrel.llm.common import mix, passes, shingle_hashes, sieve, string_bytes, whole, word_hashes
from tendrel.session import materialise


@dataclass(frozen=True)
class Sketch:
    """How candidates are found: a ring of min-hash segments over all of a record's shingles, cut into keys of `rows`
    consecutive equal segments, each the start of a chain of `reach` more whose differences are counted.

    A shingle in more than hot of all records says nothing about copying: a key whose segments all come from hot
    shingles is none. With f the smaller hot share of two records alike at t or more, shared hot shingles are at most f
    of their union, so a key is equal in both with probability t ** rows - f ** rows at least; the chain behind it stays
    within its budgets with probability viable(t). A record of hot share f has bands(t, f) keys, which grow with f, so a
    pair shares what its less hot record needs, and no key of it starts a viable chain with a probability of at most
    miss. Records whose hot share is above near of t also have keys of full_rows segments over everything, by which two
    such records find each other. lean and slack are what a chain and the whole ring may differ beyond the expected
    share, in standard deviations.
    """

    rows: int = 3
    hot: float = 0.02
    near: float = 0.9
    full_rows: int = 4
    miss: float = 9e-5
    reach: int = 56
    lean: float = 1.85
    slack: float = 4.5

    def bands(self, t: float, f: np.ndarray) -> np.ndarray:
        """Keys that records of hot shares f need; those above near * t have as many as those at it."""
        return self._keys_for((t**self.rows - np.minimum(f, self.near * t) ** self.rows) * self.viable(t))

    def full_bands(self, t: float) -> int:
        return int(self._keys_for(np.float64(t**self.full_rows * self.viable(t))))

    def ring(self, t: float) -> int:
        """Bands whose segments make up the ring: those every record has, and enough for a chain."""
        return max(int(self.bands(t, np.float64(0))), -(-self.reach // self.rows) + 1)

    def budgets(self, t: float) -> list[tuple[int, int]]:
        """(length, differences allowed) of the chain's prefixes, in proportion to their length with the `rows` equal
        segments they begin with; a segment's bit differs with probability (1 - t) / 2 at the threshold."""
        apart = (1 - t) / 2
        share = apart + self.lean * (apart * (1 - apart) / self.reach) ** 0.5
        return [(n, int((self.rows + n) * share)) for n in range(self.reach // 4, self.reach + 1, self.reach // 4)]

    def viable(self, t: float) -> float:
        """Probability that a chain of two records at the threshold stays within all its budgets."""
        apart, allowed = (1 - t) / 2, dict(self.budgets(t))
        odds = np.zeros(self.reach + 2)
        odds[0] = 1
        for n in range(1, self.reach + 1):
            odds[1:] = odds[1:] * (1 - apart) + odds[:-1] * apart
            odds[0] *= 1 - apart
            if n in allowed:
                odds[allowed[n] + 1 :] = 0
        return float(odds.sum())

    def _keys_for(self, chance: np.ndarray) -> np.ndarray:
        return np.ceil(np.log(self.miss) / np.log1p(-np.minimum(chance, 1 - 1e-9))).astype(np.int64)


#: Bits of the ring that the whole Hamming distance is taken on; each is one bit of a min-hash over all of a text's shingles.
RING_BITS = 256
#: Steps of the size code to a factor of e; it has 8 bits, the chain the other 56.
SIZE_STEPS = 16


#: Texts worked on at once, so that what a batch needs stays small; texts counted together for hot shingles.
SLICE, COUNTED = 500, 8000
#: Texts hashed at once: what a step needs of them stays in a core's cache.
CACHED = 250


def _fold(col: pa.Array) -> pa.Array:
    """The two signs outside ASCII whose lower case has an ASCII letter, as str.lower has it; the bytes do the rest."""
    if pc.any(pc.match_substring_regex(col, "[Kİ]")).as_py():
        col = pc.replace_substring(pc.replace_substring(col, "K", "k"), "İ", "i̇")
    return col


#: Bits of a run's hash; the owner within CACHED texts takes the other 11.
_HASH = np.uint64(53)


def _sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed runs of n words of each text: (hashes, owner), sorted by owner, then hash.

    Owner and hash share one 64-bit number in a slice, so that sorting it sorts by both."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in range(0, len(col), CACHED):
        h, owner = shingle_hashes(*word_hashes(*string_bytes(_fold(col[i : i + CACHED]))), n)
        both = np.sort(owner.astype(np.uint64) << _HASH | h >> (np.uint64(64) - _HASH))
        both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
        hashes.append(both & ((np.uint64(1) << _HASH) - np.uint64(1)))
        owners.append((both >> _HASH).astype(np.int64) + i)
    return np.concatenate(hashes), np.concatenate(owners)


def _lengths(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(owner, minlength=n)
    return counts, np.concatenate(([0], np.cumsum(counts)))


def _scattered(x: np.ndarray) -> np.ndarray:
    """The numbers out of order: a shingle whose numbers rise by small steps would else be the least many times over."""
    y = x >> np.uint32(15)
    y ^= x
    y *= np.uint32(0x2C1B3C6D)
    return y


def _slots(h: np.ndarray, owner: np.ndarray, n: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Min-hash segments of each value that has any shingle: (their owners, segments as owners x slots)."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros((0, slots), np.uint32)
    start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    h = mix(h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.empty((slots, len(start)), dtype=np.uint32)
    x = low.copy()
    for j in range(slots):
        x += high
        out[j] = np.minimum.reduceat(_scattered(x), start)
    return owner[start], np.ascontiguousarray(out.T)


def _gated(h: np.ndarray, owner: np.ndarray, rare: np.ndarray, bands: np.ndarray, rows: int, seed: int, ring: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, band, key) of each value's first bands keys that hold a segment of a rare shingle, and the ring: a bit of
    each segment of the first `ring` bands, values x (ring * rows)."""
    who, at, keys = [], [], []
    bits = np.zeros((len(bands), ring * rows), np.uint8)
    h = mix(h ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    x, step, mark = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1), rare.astype(np.uint32)
    need = np.maximum(bands, ring)[owner]
    start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    for band in range(int(need.max(initial=0))):
        if band % 16 == 0:  # values that have all their keys leave
            stay = need > band
            if not stay.all():
                x, step, mark, need, owner = x[stay], step[stay], mark[stay], need[stay], owner[stay]
                start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        key, any_rare = np.full(len(start), mix(np.array([(seed << 32) + band], np.uint64))[0]), np.zeros(len(start), bool)
        for r in range(rows):
            x += step
            y = _scattered(x)
            # the lowest bit says whether the least shingle is a rare one
            y &= np.uint32(0xFFFFFFFE)
            y |= mark
            least = np.minimum.reduceat(y, start)
            any_rare |= (least & np.uint32(1)).astype(bool)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            if band < ring:
                bits[owner[start], band * rows + r] = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
        ok = any_rare & (bands[owner[start]] > band)
        who.append(owner[start][ok])
        at.append(np.full(ok.sum(), band))
        keys.append(key[ok])
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), bits
    return np.concatenate(who), np.concatenate(at), np.concatenate(keys), bits


def _words_of(bits: np.ndarray, rows: int, reach: int) -> np.ndarray:
    """The chains of a ring as words, values x bands: bit j of a band's word is the j-th segment behind the band's own."""
    n, size = bits.shape
    starts = np.arange(0, size, rows) + rows
    out = np.zeros((n, len(starts)), np.uint64)
    for j in range(reach):
        out |= bits[:, (starts + j) % size].astype(np.uint64) << np.uint64(j)
    return out


def _chains(slots: np.ndarray, rows: int, tag: int) -> np.ndarray:
    """One 64-bit key for each chain of rows consecutive segments."""
    n, m = slots.shape
    s = slots.reshape(n, m // rows, rows).astype(np.uint64)
    key = np.arange(m // rows, dtype=np.uint64)[None, :] + np.uint64(tag)
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, i])
    return key


def hot_shingles(texts: DataFrame, share: float, n: int) -> np.ndarray:
    """Hashes of the word runs that more than share of all texts hold, by lossy counting over all texts.

    Each window of COUNTED texts drops runs it sees in under a tenth of share of its own texts (in none, where that is
    less than one), so counts are low by at most a tenth of share of all texts. A text has len runs, so at most
    10 * mean(len) / share runs stay per window of COUNTED texts or more, and mean(len) / (0.9 * share) are found in the
    end, whatever the number of texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        rows = 0

        def counted() -> pa.RecordBatch:
            values, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for col in held:
                h, _ = _sets(col, n)
                value, times = np.unique(h, return_counts=True)
                values, back = np.unique(np.concatenate((values, value)), return_inverse=True)
                seen = np.bincount(back, weights=np.concatenate((seen, times)), minlength=len(values)).astype(np.int64)
            keep = seen >= share * 0.1 * rows
            # a row with a null run has the number of texts
            return pa.RecordBatch.from_arrays([pa.array([*values[keep].view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(seen[keep], rows))], ["h", "seen"])

        for b in batches:
            held.append(whole(b.column(0)))
            rows += b.num_rows
            if rows >= COUNTED:
                yield counted()
                held, rows = [], 0
        if rows:
            yield counted()

    counted = materialise(texts.mapInArrow(count, "h bigint, seen bigint").groupBy("h").agg(F.sum("seen").alias("seen")))
    total = counted.where("h is null").agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    found = counted.where(F.col("h").isNotNull() & (F.col("seen") > total * share * 0.9)).select("h").toPandas()["h"]
    return np.sort(found.to_numpy(dtype=np.int64)).view(np.uint64)


def text_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, rep): each non-null key with a non-null text and the least key of those with the same text.

    Equal texts are grouped before any row of them is gathered; the join back splits a hot text by adaptive execution.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("same")).where("id is not null and same is not null")
    return rows.join(rows.groupBy("same").agg(F.min("id").alias("rep")), "same").select("id", "rep").distinct()


def near_pairs(
    df: DataFrame, key: str = "chunk_ix", text: str = "text", threshold: float = 0.5, words: int = 3, sketch: Sketch = Sketch()
) -> tuple[DataFrame, DataFrame]:
    """(links, classes): pairs (a, b, likeness) of different texts alike at threshold or more, a < b, between the
    representatives of equal texts; and (id, rep) for every key.

    Likeness is the Jaccard index of the texts' distinct runs of `words` words, words being runs of a-z0-9 in lower
    case. Null texts and keys and texts of fewer words take no part; repeated rows count once; other columns are
    ignored. A text without words has a class but no links.

    Method (pigeonring on min-hash segments): each text is a ring of segments, and two texts at the threshold differ in
    at most a known number of them, up to sampling. A candidate needs a chain that begins with `rows` equal segments (not
    all of hot shingles) and whose cumulative differences stay within budgets in proportion to its length; this and the
    texts' sizes are tested where the keys meet, so pairs without a viable chain are never shuffled. What remains takes
    the Hamming test over a whole ring of its own, and then the exact check.

    Keys are joined by sort-merge, so a hot key is split by adaptive execution; equal texts are one row before that. No
    pair is capped.
    """
    classes = materialise(text_classes(df, key, text))
    copies = materialise(classes.where("id <> rep").select("id"))
    texts = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").join(copies, "id", "left_anti")
    hot = df.sparkSession.sparkContext.broadcast(hot_shingles(texts.select("text"), sketch.hot, words))
    keyed = texts.mapInArrow(_sign(threshold, words, sketch, hot), "k bigint, id bigint, m bigint")
    x, y = keyed.alias("x"), keyed.alias("y")
    candidates = materialise(x.join(y, F.expr(f"x.k = y.k and x.id < y.id and {chain_condition(threshold, sketch)}")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    # a text that no candidate needs is passed over before it is shuffled; those let through by chance find no pair
    hashed = texts.select("id", F.xxhash64("id").alias("u"), "text")
    rings = hashed.mapInArrow(_rings(words, _needed(candidates)), "id bigint, size int, ring binary").dropDuplicates(["id"])
    near = materialise(
        candidates.join(rings.toDF("a", "size_a", "ring_a"), "a").join(rings.toDF("b", "size_b", "ring_b"), "b")
        .where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold)
        .mapInArrow(_within(threshold, sketch.slack), "a bigint, b bigint")
    )
    sets = hashed.mapInArrow(_hash_sets(words, _needed(near)), "id bigint, h binary").dropDuplicates(["id"])
    exact = (
        near.join(sets.toDF("a", "h_a"), "a").join(sets.toDF("b", "h_b"), "b")
        .select("a", "b", "h_a", "h_b").mapInArrow(_check(threshold), "a bigint, b bigint, likeness double")
    )
    return exact, classes


def chain_condition(threshold: float, sketch: Sketch) -> str:
    """SQL: whether the chains of x.m and y.m stay within their budgets and the texts' sizes within their ratio."""
    sizes = f"abs(shiftrightunsigned(x.m, 56) - shiftrightunsigned(y.m, 56)) <= {int(np.ceil(SIZE_STEPS * -np.log(threshold)))}"
    return " and ".join([sizes, *(f"bit_count((x.m ^ y.m) & {(1 << n) - 1}L) <= {most}" for n, most in sketch.budgets(threshold))])


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices, without ids (column 0) that this task has had: of repeated rows one stays per task."""
    had: set[int] = set()
    for whole_batch in batches:
        for i in range(0, whole_batch.num_rows, SLICE):
            b = whole_batch[i : i + SLICE]
            new = [i not in had and not had.add(i) for i in b.column(0).to_pylist()]
            yield b if all(new) else b.filter(pa.array(new, pa.bool_()))


def _sign(threshold: float, words: int, sketch: Sketch, hot):
    """(id, text) to rows (k, id, m): a key, and the size code with the chain behind it."""
    ring, reach = sketch.ring(threshold), sketch.reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _fresh(batches):
            col, n = whole(b.column(1)), b.num_rows
            h, owner = _sets(col, words)
            every, _ = _lengths(owner, n)
            rare = ~np.isin(h, hot.value)
            share = 1 - np.bincount(owner[rare], minlength=n) / np.maximum(every, 1)
            who, band, keys, bits = _gated(h, owner, rare, sketch.bands(threshold, share), sketch.rows, 1, ring)
            heavy = (share > sketch.near * threshold) & (every > 0)
            sel, full = heavy[owner], sketch.full_bands(threshold)
            who2, slots2 = _slots(h[sel], owner[sel], n, full * sketch.full_rows, 2)
            who = np.concatenate((who, np.repeat(who2, full)))
            band = np.concatenate((band, np.tile(np.arange(full), len(who2))))
            keys = np.concatenate((keys, _chains(slots2, sketch.full_rows, 2 << 32).ravel()))
            code = np.log(np.maximum(every, 1)) * SIZE_STEPS
            m = _words_of(bits, sketch.rows, reach)[who, band % ring] | np.minimum(code, 255).astype(np.uint64)[who] << np.uint64(56)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0).take(pa.array(who)), pa.array(m.view(np.int64))], ["k", "id", "m"])

    return run


def _rings(words: int, needed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (_wanted(b, needed.value) for b in _fresh(batches)):
            h, owner = _sets(whole(b.column(2)), words)
            every, _ = _lengths(owner, b.num_rows)
            who, slots = _slots(h, owner, b.num_rows, RING_BITS, 3)
            packed = np.packbits((slots & 1).astype(np.uint8), axis=1)
            rings = pa.array([r.tobytes() for r in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), pa.array(every[who].astype(np.int32)), rings], ["id", "size", "ring"])

    return run


def _within(threshold: float, slack: float):
    """The whole Hamming test of candidate pairs, on rings apart from those that chains are taken from.

    A bit differs with probability (1 - threshold) / 2 at the threshold, so the rings' distance is at most
    bits * (1 - threshold) / 2 + slack deviations; a pair further apart is pruned before its sets are fetched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            names = b.schema.names
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(b.column(names.index(c)).to_pylist()), np.uint8).reshape(n, -1) for c in ("ring_a", "ring_b"))
            m, apart = x.shape[1], (1 - threshold) / 2
            budget = 8 * m * (apart + slack * np.sqrt(apart * (1 - apart) / (8 * m)))
            ok = pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= budget + 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(names.index("a")).filter(ok), b.column(names.index("b")).filter(ok)], ["a", "b"])

    return run


def _needed(pairs: DataFrame):
    return sieve(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select(F.xxhash64("id").alias("u")))


def _wanted(b: pa.RecordBatch, words: np.ndarray) -> pa.RecordBatch:
    """The rows of (id, hash of id, ...) whose id the filter lets through."""
    return b.filter(pa.array(passes(words, np.asarray(b.column(1)).view(np.uint64))))


#: Bytes of a run's hash in the exact check: two texts of 1,000 runs have one wrong match with a probability of 1e-6.
SET_BYTES = 5


def _hash_sets(words: int, needed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (_wanted(b, needed.value) for b in _fresh(batches)):
            h, owner = _sets(whole(b.column(2)), words)
            _, at = _lengths(owner, b.num_rows)
            short = np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES])
            sets = [short[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "h"])

    return run


def _set(raw: pa.Scalar) -> np.ndarray:
    short = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, SET_BYTES)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :SET_BYTES] = short
    return out.view("<u8").ravel()


def _check(threshold: float):
    """The exact likeness of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            out = []
            for p, q in zip(b.column(names.index("h_a")), b.column(names.index("h_b"))):
                x, y = _set(p), _set(q)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both))
            like = pa.array(out, pa.float64())
            ok = pc.greater_equal(like, threshold)
            yield pa.RecordBatch.from_arrays([b.column(names.index(c)).filter(ok) for c in ("a", "b")] + [like.filter(ok)], ["a", "b", "likeness"])

    return run


def expand_pairs(links: DataFrame, classes: DataFrame, sizes_up_to: int = 64) -> DataFrame:
    """(a, b) of ids, a < b: links between all members of linked classes, and pairs within a class.

    In a class of more than sizes_up_to equal texts, each member is paired with the representative, and only the
    representative carries the class's links to other texts: membership (id, rep) holds the rest, so nothing is lost
    and no pair count is quadratic in the number of copies. Smaller classes are expanded in full.
    """
    own = classes.join(classes.groupBy("rep").agg(F.count("*").alias("n")), "rep")
    member = own.where((F.col("n") <= sizes_up_to) | (F.col("id") == F.col("rep")))
    left, right = member.select(F.col("rep").alias("a"), F.col("id").alias("ia")), member.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select("ia", "ib")
    several = own.where("n > 1")
    small = several.where(F.col("n") <= sizes_up_to)
    within = (
        small.select("rep", F.col("id").alias("ia")).join(small.select("rep", F.col("id").alias("ib")), "rep").where("ia < ib").select("ia", "ib")
        .unionByName(several.where((F.col("n") > sizes_up_to) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("ia"), F.col("id").alias("ib")))
    )
    return across.unionByName(within).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def groups(links: DataFrame, classes: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, group_id, links): the connected component of each id, named by its least id, and how many texts its own
    text is linked to. Equal texts share the component and the links of their representative.

    Alternating large-star and small-star steps on the links between representatives; each is one shuffle of the
    links by vertex, and the number of steps grows as the logarithm of the largest component.
    """
    edges = materialise(links.select("a", "b"))
    linked = edges.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    state, before = edges, None
    for _ in range(rounds):
        state = materialise(_small_star(_large_star(state)))
        now = state.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    names = state.select(F.col("b").alias("rep"), F.col("a").alias("least"))
    return (
        classes.join(names, "rep", "left").join(linked, "rep", "left")
        .select("id", F.coalesce("least", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(edges: DataFrame, vertex: str, other: str) -> DataFrame:
    """Adds least: the least neighbour of each edge's vertex. Grouped first and joined back, so that a hub's edges are
    split by adaptive execution and never sit in one window."""
    return edges.join(edges.groupBy(vertex).agg(F.min(other).alias("least")), vertex)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the least of it and its neighbours; rows are (least, vertex)."""
    both = _with_least(_neighbours(edges), "a", "b")
    return both.where("b > a").select(F.least("a", "least").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the least of them."""
    down = _with_least(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")), "v", "u")
    kept = down.select(F.col("least").alias("a"), F.col("u").alias("b")).where("a < b")
    return kept.unionByName(down.select(F.col("least").alias("a"), F.col("v").alias("b"))).distinct()
