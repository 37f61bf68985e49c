import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tendrel.llm import mixture as mx
from tendrel.llm import packing as pk
from tendrel.llm import tokens as tk

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tk.VOCABULARY), reason="no vocabulary file here")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_places_everything_once(sizes):
    bins = pk.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    if sizes:
        assert len(bins) <= 1.7 * -(-sum(sizes) // 50) + 1


def placed(bins, items):
    got = sorted((i["id"], i["part"], i["size"]) for b in bins for i in b["items"])
    assert got == sorted(items)
    assert all(b["used"] == sum(i["size"] for i in b["items"]) for b in bins)


@pytest.mark.parametrize("at_once", [20, 50_000])
def test_pack(frame, at_once):
    r = random.Random(1)
    items = [(i, 1, r.randrange(1, 101)) for i in range(500)]
    bins = pk.pack(frame(items, "id bigint, part int, size int").repartition(6), 100, at_once=at_once).collect()
    placed(bins, items)
    assert all(b["used"] <= 100 for b in bins)
    whole = len(pk.best_fit([s for _, _, s in items], 100))
    assert len(bins) <= whole * (1.05 if at_once > 500 else 1.1)


def test_items_that_never_share(frame):
    items = [(i, 1, 60) for i in range(200)]
    bins = pk.pack(frame(items, "id bigint, part int, size int"), 100, at_once=10).collect()
    placed(bins, items)
    assert len(bins) == 200


@needs_vocabulary
def test_fill_containers(frame):
    text = "The Supplier keeps a staffed service desk. "
    rows = [(i, text * (1 + i % 9), "x") for i in range(60)] + [(0, text, "x"), (100, text * 200, "x"), (101, None, "x"), (102, "", "x"), (None, text, "x")]
    got = pk.fill_containers(frame(rows, "doc_id bigint, text string, used string"), 256).collect()
    count = tk.encoding(tk.VOCABULARY).encode_ordinary
    for i, t, _ in rows[:60] + [rows[61]]:
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["part"])
        assert sum(r["tokens"] for r in own) == len(count(t))
        assert len(own) == -(-len(count(t)) // 256) and [r["first_token"] for r in own] == [256 * k for k in range(len(own))]
    assert {r["doc_id"] for r in got} == set(range(60)) | {100}
    by = {}
    for r in got:
        by[r["container_id"]] = by.get(r["container_id"], 0) + r["tokens"]
    assert max(by.values()) <= 256 and all(r["used"] == by[r["container_id"]] for r in got)
    report = pk.fill_report(pk.fill_containers(frame(rows, "doc_id bigint, text string, used string"), 256), 256).first()
    assert report["containers"] == len(by) and report["fill"] > 0.95
    empty = pk.fill_containers(frame([], "doc_id bigint, text string"), 256)
    assert empty.collect() == [] and pk.fill_report(empty, 256).first()["containers"] == 0


def test_water_filling():
    sizes = {"a": 100.0, "b": 100.0, "c": 10.0}
    got = mx.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, sizes, {"a": 2, "b": 2, "c": 2}, 210)
    assert got["c"] == 20 and got["a"] == pytest.approx(190 * 5 / 8) and got["b"] == pytest.approx(190 * 3 / 8)
    assert mx.water_fill({"a": 1.0}, {"a": 10.0}, {"a": 1}, 50) == {"a": 10.0}
    assert mx.water_fill({"a": 1.0, "z": 1.0}, {"a": 10.0}, {"a": 3, "z": 1}, 20) == {"a": 20.0, "z": 0.0}
    assert mx.water_fill({}, {}, {}, 0) == {}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0.01, 1), st.integers(1, 500), st.integers(1, 4)), min_size=1))
def test_water_filling_holds_its_bounds(sources):
    total = sum(s for _, s, _ in sources.values())
    got = mx.water_fill({k: t for k, (t, _, _) in sources.items()}, {k: s for k, (_, s, _) in sources.items()}, {k: r for k, (_, _, r) in sources.items()}, total)
    assert all(0 <= got[k] <= s * r + 1e-6 for k, (_, s, r) in sources.items()) and sum(got.values()) == pytest.approx(total)


@needs_vocabulary
def test_mix_sources(frame):
    r = random.Random(2)
    rows, n = [], 0
    for source, docs in (("a", 900), ("b", 300), ("c", 30), ("x", 40)):
        for _ in range(docs):
            rows.append((n, " ".join(f"word{r.randrange(999)}" for _ in range(r.randrange(5, 20))), source, "z"))
            n += 1
    rows += [rows[0], rows[0], (9001, rows[0][1], "a", "z"), (9002, None, "a", "z"), (9003, "", "b", "z"), (None, "text here", "a", "z"), (9004, "no source", None, "z")]
    sources = frame([("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.2, 3), ("x", None, None), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    schema = "doc_id bigint, text string, source string, copies string"
    mixture, report = mx.mix_sources(frame(rows, schema), sources)
    got = {row["doc_id"]: row for row in mixture.collect()}
    assert len(got) == mixture.count() and 9001 not in got and not set(got) & {9002, 9003, 9004, None}
    rep = {row["source"]: row for row in report.collect()}
    assert set(rep) == {"a", "b", "c", "gone"} and rep["gone"]["given"] == 0
    for s, row in rep.items():
        assert row["most_copies"] <= row["max_repeats"]
        assert row["given"] == sum(g["tokens"] * g["copies"] for g in got.values() if g["source"] == s)
    sizes = {s: rep[s]["size"] for s in "abc"}
    want = mx.water_fill({"a": 0.4, "b": 0.4, "c": 0.2}, sizes, {"a": 1, "b": 2, "c": 3}, sum(sizes.values()))
    for s in "abc":
        assert abs(rep[s]["given"] - want[s]) <= 60
    again = {row["doc_id"]: row["copies"] for row in mx.mix_sources(frame(rows, schema).repartition(5), sources)[0].collect()}
    assert again == {k: v["copies"] for k, v in got.items()}
    other = {row["doc_id"]: row["copies"] for row in mx.mix_sources(frame(rows, schema), sources, seed=2)[0].collect()}
    assert other != again
    assert mx.mix_sources(frame([], schema), sources)[0].collect() == []


@needs_vocabulary
def test_counts_are_the_tokenizers(frame):
    got = {r["id"]: r["tokens"] for r in tk.with_tokens(frame([(1, "The Supplier's 27 desks"), (2, None), (3, "")], "id bigint, text string"), "text", "id").collect()}
    assert got == {1: len(tk.encoding(tk.VOCABULARY).encode_ordinary("The Supplier's 27 desks")), 2: 0, 3: 0}
    assert F.col is not None
