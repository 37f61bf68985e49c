import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tendrel.llm import enrichment as e

SCHEMA = "tab string, rec_id bigint, tokens array<string>, rank string"


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.integers(0, 200), st.integers(1, 60))
def test_tail_is_exact(n, K, rest, k):
    N = n + K + rest
    k = min(k, n, K)
    total = sum(math.comb(K, i) * math.comb(N - K, n - i) for i in range(k, min(n, K) + 1) if n - i <= N - K)
    want = math.log(total / math.comb(N, n))
    got = e.hypergeometric_log_tail(*(np.array([x]) for x in (k, n, K, N)))[0]
    assert got == pytest.approx(want, rel=1e-8, abs=1e-9)


def test_log_gamma():
    x = np.array([0.5, 1, 2, 3.7, 10, 1e3, 1e6, 1e9])
    assert e.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-13)


def test_adjustment_is_benjamini_hochberg():
    p = np.log(np.array([0.01, 0.04, 0.03, 0.5, 0.2, 0.2]))
    owner = np.array([0, 0, 0, 0, 1, 1])
    assert np.exp(e.adjusted(p, owner)) == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5, 0.2, 0.2])


def brute(records):
    docs = {}
    for tab, rec, tokens in records:
        if rec is None:
            continue
        terms = Counter(t.strip().lower() for t in tokens or [] if t and t.strip())
        if terms:
            docs[tab, rec] = terms
    out = {}
    for tab in {t for t, _ in docs}:
        own = {k: v for k, v in docs.items() if k[0] == tab}
        df = Counter(t for v in own.values() for t in v)
        for key, terms in own.items():
            ranked = sorted((-round(c * math.log(len(own) / df[t]), 6), t) for t, c in terms.items() if df[t] > 1)
            if ranked:
                out[key] = ranked[0][1]
    return out


RECORDS = [
    ("a", 1, ["Fire", " fire ", "gate", ""]), ("a", 1, ["Fire", " fire ", "gate", ""]), ("a", 2, ["gate", "gate", "fire", None]), ("a", 3, ["gate", "lone"]), ("a", 4, []), ("a", 5, None),
    ("a", 6, [" ", ""]), ("a", None, ["gate"]), ("b", 1, ["gate", "post"]), ("b", 2, ["post", "gate"]), ("b", 3, ["x"] * 5000 + ["gate"]),
]


@pytest.mark.parametrize("hot", [1, 10_000])
def test_best_terms(frame, hot):
    df = frame([(*r, "extra") for r in RECORDS], SCHEMA)
    scored = e.distinctive_terms(df, hot=hot)
    assert {(r["tab"], r["rec_id"]): r["term"] for r in e.best_term(scored, "tf_idf").collect()} == brute(RECORDS)
    rows = {(r["tab"], r["rec_id"]): r for r in scored.collect()}
    assert len(rows) == 6
    r = rows["a", 1]
    stats = dict(zip(r["term"], zip(r["tf"], r["records"], r["p_log"])))
    # 8 tokens in tab a, 3 of them fire; the record has 3 tokens, 2 of them fire
    assert stats["fire"][:2] == (2, 2)
    assert stats["fire"][2] == pytest.approx(math.log((math.comb(3, 2) * 5 + 1) / math.comb(8, 3)))


def test_equal_counts_score_equally(frame):
    rows = e.distinctive_terms(frame([("a", i, ["x", "y"], "") for i in range(4)], SCHEMA)).collect()
    assert all(r["score"][0] == r["score"][1] for r in rows)


def test_empty_table(frame):
    assert e.best_term(e.distinctive_terms(frame([], SCHEMA))).collect() == []
