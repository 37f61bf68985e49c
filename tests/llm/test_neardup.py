import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tendrel.llm import neardup as nd

SCHEMA = "chunk_ix bigint, text string, a string, id int"


def grams(text):
    w = re.findall("[a-z0-9]+", text.lower())
    return set(zip(w, w[1:], w[2:]))


def brute(rows, threshold=0.5):
    texts = {}
    for k, t, *_ in rows:
        if k is not None and t is not None and grams(t):
            texts[k] = grams(t)
    out = set()
    for a in texts:
        for b in texts:
            if a < b and len(texts[a] & texts[b]) >= threshold * len(texts[a] | texts[b]):
                out.add((a, b))
    return out


def corpus(seed, n=120):
    """Template texts with shared runs, reworked copies of them, and a hot group."""
    r = random.Random(seed)
    templates = [" ".join(f"t{r.randrange(60)}" for _ in range(12)) for _ in range(12)]
    rows, originals = [], []
    for i in range(n):
        if originals and r.random() < 0.5:
            w = r.choice(originals).split()
            for _ in range(r.randrange(0, len(w) // 4)):
                w[r.randrange(len(w))] = f"e{r.randrange(1000)}"
            text = " ".join(w)
        else:
            text = ". ".join(f"{r.choice(templates)} n{r.randrange(10**6)} m{r.randrange(10**6)}" for _ in range(8))
            originals.append(text)
        rows.append((i, text, "x", 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(frame, seed):
    rows = corpus(seed)
    rows += [rows[3], rows[3], (500, rows[3][1], "x", 1), (501, rows[3][1].upper(), "x", 1), (502, None, "x", 1), (503, "", "x", 1), (504, "two words", "x", 1), (None, rows[3][1], "x", 1)]
    rows += [(505, "K İ three four five six", "x", 1), (506, "k i three four five six", "x", 1)]
    links, classes = nd.near_pairs(frame(rows, SCHEMA))
    got = {tuple(r) for r in nd.expand_pairs(links, classes).collect()}
    assert got == brute(rows)
    by = {tuple(r)[:2]: r["likeness"] for r in links.collect()}
    assert all(a < b for a, b in by)


def test_hot_texts_find_each_other(frame):
    """Every text is made of runs that most texts share: the chains over all shingles must find them."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base + f" tail{i} end{i}", "x", 1) for i in range(30)]
    links, classes = nd.near_pairs(frame(rows, SCHEMA))
    assert {tuple(r)[:2] for r in links.collect()} == brute(rows)


def boilerplate(seed, pairs=130):
    """Pairs of texts alike at 0.5 to 0.6 that share a block which a quarter of all texts hold: it makes up 0.3 to 0.5 of
    the longer text and up to nine tenths of the other."""
    r = random.Random(seed)
    new = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    blocks = [new(62) for _ in range(4)]  # 60 runs each
    rows = []
    for i in range(pairs):
        long = round(60 / r.uniform(0.3, 0.5))
        like = r.uniform(0.5, 0.6)
        block, least = blocks[i % 4], max(2, int(like * long) - 60 + 3)
        if i % 2:  # nearly all of the shorter text is in the longer one
            shared = new(least)
            rows += [(2 * i, f"{block} {shared} {new(max(0, long - 60 - least))}", "x", 1), (2 * i + 1, f"{block} {shared}", "x", 1)]
        else:
            shared = new(round(long * 2 * like / (1 + like)) - 60 + 3)
            own = max(0, long - 60 - len(shared.split()))
            rows += [(2 * i, f"{block} {shared} {new(own)}", "x", 1), (2 * i + 1, f"{block} {shared} {new(own)}", "x", 1)]
    return rows


def test_shared_boilerplate_hides_no_pair(frame):
    rows = boilerplate(4)
    links, _ = nd.near_pairs(frame(rows, SCHEMA))
    want = brute(rows)
    assert len(want) > 100 and {tuple(r)[:2] for r in links.collect()} == want


@pytest.mark.parametrize("hot, rare, other, shared", [(60, 8, 61, 8), (48, 12, 72, 12), (36, 24, 84, 24), (40, 60, 60, 27)])
def test_chains_of_mixed_pairs(hot, rare, other, shared):
    """Two texts of hot runs and rare ones, shared of these in both: a chain in common whatever the hot shares."""
    r, n = np.random.default_rng(1), 300
    draw = lambda k: r.integers(0, 1 << 62, k, dtype=np.uint64)
    h, size = [], (hot + rare, hot + other)
    for _ in range(n):
        both = draw(hot + shared)
        h += [both, draw(rare - shared), both, draw(other - shared)]
    owner = np.repeat(np.arange(2 * n), np.tile(size, n))
    is_rare = np.concatenate([np.arange(size[i % 2]) >= hot for i in range(2 * n)])
    bands = nd.Sketch().bands(0.5, np.array([hot / size[0], hot / size[1]] * n))
    who, _, keys, _ = nd._gated(np.concatenate(h), owner, is_rare, bands, nd.Sketch().rows, 1)
    of = [set(keys[who == i].tolist()) for i in range(2 * n)]
    assert all(of[2 * i] & of[2 * i + 1] for i in range(n))


def half_hot(seed, pairs, hot, rare, shared):
    """Pairs of texts of hot + rare runs each, the hot ones (of a block that a tenth of all texts hold) and shared of the rare
    ones in both: likeness (hot + shared) / (hot + 2 * rare - shared)."""
    r = random.Random(seed)
    new = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    blocks = [new(hot + 2) for _ in range(10)]
    rows = []
    for i in range(pairs):
        both = new(shared)
        rows += [(2 * i + j, f"{blocks[i % 10]} {both} {new(rare - shared)}", "x", 1) for j in (0, 1)]
    return rows


def test_pairs_of_texts_nearly_half_hot(frame):
    """600 pairs just over the threshold, 47 of 100 runs hot: all the likeness that chains may use is in the rare half."""
    rows = half_hot(5, 600, 47, 53, 23)
    want = {(2 * i, 2 * i + 1) for i in range(600) if (g := [grams(rows[2 * i + j][1]) for j in (0, 1)]) and len(g[0] & g[1]) >= 0.5 * len(g[0] | g[1])}
    links, _ = nd.near_pairs(frame(rows, SCHEMA))
    got = {tuple(r)[:2] for r in links.collect()}
    assert len(want) == 600 and len(got & want) >= 0.99 * len(want) and {p for p in got if p[1] != p[0] + 1} == set()


def chain_of(texts, sketch, threshold=0.5):
    """The chain words and sizes of texts by band, and the whole ring."""
    h, owner = nd._sets(pa.array(texts), 3)
    ring = sketch.ring(threshold)
    _, _, _, bits = nd._gated(h, owner, np.ones(len(h), bool), np.zeros(len(texts), np.int64), sketch.rows, 1, ring)
    return nd._words_of(bits, sketch.rows, sketch.reach), bits


def test_chains_prune_what_the_whole_distance_lets_through():
    """Of pairs within the whole ring's budget, a chain's own budgets prune more, and they keep pairs at the threshold."""
    r, sketch = random.Random(8), nd.Sketch()
    far, near = [], []
    for out, shared in ((far, 45), (near, 68)):  # of 100 words each: likeness about 0.28 and 0.5
        for _ in range(300):
            both = [f"u{r.randrange(10**9)}" for _ in range(shared)]
            out += [" ".join(both + [f"u{r.randrange(10**9)}" for _ in range(100 - shared)]) for _ in (0, 1)]
    kept = {}
    for name, texts in (("far", far), ("near", near)):
        words, bits = chain_of(texts, sketch)
        differ = words[0::2] ^ words[1::2]
        viable = np.all([np.bitwise_count(differ & np.uint64((1 << n) - 1)) <= most for n, most in sketch.budgets(0.5)], axis=0)
        n = bits.shape[1]
        total = (bits[0::2] != bits[1::2]).sum(axis=1) <= n * 0.25 + 4.5 * (n * 0.1875) ** 0.5
        kept[name] = viable[total].mean(), total.mean()
    assert kept["far"][1] > 0.5 and kept["far"][0] < 0.7
    assert kept["near"][1] > 0.99 and kept["near"][0] > sketch.viable(0.5) - 0.03


def test_pigeonring_start():
    """The ring principle the chains rest on: a ring within its whole budget has a start from which every chain is."""
    r = np.random.default_rng(3)
    for _ in range(300):
        ring = r.integers(0, 2, 60)
        share = ring.sum() / 60
        assert any(all(np.cumsum(np.roll(ring, -i)) <= share * np.arange(1, 61) + 1e-9) for i in range(60))


def test_large_classes_stay_linear(frame):
    text = "the same nine words stand in each of these"
    rows = [(i, text, "x", 1) for i in range(100)] + [(200, text + " here", "x", 1)]
    links, classes = nd.near_pairs(frame(rows, SCHEMA))
    pairs = {tuple(r) for r in nd.expand_pairs(links, classes, sizes_up_to=10).collect()}
    assert pairs == {(0, i) for i in range(1, 100)} | {(0, 200)}
    g = {r["id"]: r for r in nd.groups(links, classes).collect()}
    assert len(g) == 101 and {r["group_id"] for r in g.values()} == {0} and {r["links"] for r in g.values()} == {1}


def test_members_rebuild_pairs_of_large_classes(spark, frame, tmp_path):
    """The queries' output alone gives every pair of a class too large to be written out."""
    from tendrel.llm.queries import queries

    text = "the same nine words stand in each of these"
    rows = [(i, text, "x", 1) for i in range(70)] + [(200 + i, text + " here", "x", 1) for i in range(2)] + [(300, "nothing of the kind is said in this one", "x", 1)]
    frame(rows, SCHEMA).write.parquet(str(tmp_path / "chunks.parquet"))
    frame([("near_duplicate_min", 0.5)], "limit_name string, amount double").write.parquet(str(tmp_path / "size_limits.parquet"))
    made = {n: [tuple(r) for r in queries()[n](spark, str(tmp_path)).collect()] for n in ("p6_found", "p6_members")}
    assert {c for *_, c in made["p6_members"]} == {1, 2, 70}
    made["p6_members"] = [x[:2] for x in made["p6_members"]]
    rep = dict(made["p6_members"])
    assert len(made["p6_members"]) == len(rep) == len(rows)
    linked = {frozenset((rep[a], rep[b])) for a, b in made["p6_found"]}
    assert {(a, b) for a in rep for b in rep if a < b and (rep[a] == rep[b] or frozenset((rep[a], rep[b])) in linked)} == brute(rows)


def test_components(spark, frame):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (101, 102)]
    links = frame(edges, "a bigint, b bigint")
    classes = frame([(i, i) for i in [*range(41), 100, 101, 102, 300]], "id bigint, rep bigint")
    got = {r["id"]: (r["group_id"], r["links"]) for r in nd.groups(links, classes).collect()}
    assert all(got[i][0] == 0 for i in range(41)) and got[102] == (100, 2) and got[101] == (100, 1) and got[300] == (300, 0)


def test_empty(frame):
    links, classes = nd.near_pairs(frame([], SCHEMA))
    assert links.collect() == [] and nd.expand_pairs(links, classes).collect() == [] and nd.groups(links, classes).collect() == []


def test_long_texts(frame):
    a = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, a, "", 1), (2, a + " more", "", 1), (3, " ".join(f"v{i}" for i in range(10)), "", 1)]
    links, _ = nd.near_pairs(frame(rows, SCHEMA))
    assert [tuple(r)[:2] for r in links.collect()] == [(1, 2)]
    assert frame(rows, SCHEMA).where(F.col("chunk_ix") == 1).count() == 1
