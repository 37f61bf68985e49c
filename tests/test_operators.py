import math

import pytest
from pyspark.sql import functions as F

from tendrel.functions import rules
from tendrel.operators import chunking, drafting, extract, index, verdict
from tendrel.plans import pipeline

CHUNKS = "chunk_ix bigint, doc string, heading string, text string, tokens array<string>"


def library(spark, *token_lists):
    return spark.createDataFrame([(i, f"d{i}", "", "", t) for i, t in enumerate(token_lists)], CHUNKS)


def asked(spark, *token_lists):
    return spark.createDataFrame([(i, t, True, f"R-{i:03d}", i) for i, t in enumerate(token_lists)], "key bigint, tokens array<string>, binding boolean, id string, line_no int")


def test_scores_by_hand(spark):
    chunks = library(spark, ["a", "b"], ["a", "c", "c", "d"])
    queries = asked(spark, ["a", "c"], ["a", "c", "z"], ["z"], [])
    ranked = {(r["key"], r["chunk_ix"]): r for r in index.best_sections(queries, chunks, "key").collect()}
    assert round(ranked[0, 1]["score"], 6) == 1.052924 and ranked[0, 1]["rank"] == 1
    assert round(ranked[0, 0]["score"], 6) == 0.214496
    rows = {r["key"]: r for r in pipeline.assess(queries, chunks).collect()}
    assert rows[0]["coverage"] == 1.0 and rows[0]["evidence"] == 1 and rows[0]["supporting"] == [0]
    assert round(rows[1]["coverage"], 6) == 0.516718 and rows[1]["verdict"] == "WEAK"
    for k in (2, 3):
        assert (rows[k]["coverage"], rows[k]["relevance"], rows[k]["evidence"], rows[k]["verdict"], rows[k]["critical"]) == (0.0, 0.0, None, "GAP", True)
        assert rows[k]["citation"] == "— no matching evidence —"
    stats = index.corpus_stats(chunks).first()
    assert round(stats["unseen_idf"], 6) == round(math.log(2), 6) and stats["avg_len"] == 3.0


def test_of_equal_sections_the_later_is_cited(spark):
    ranked = index.best_sections(asked(spark, ["a"]), library(spark, ["a", "b"], ["x"], ["a", "b"]), "key").orderBy("rank").collect()
    assert [r["chunk_ix"] for r in ranked] == [2, 0]


def test_ranks_do_not_depend_on_blocks_or_partitions(spark):
    words = [f"w{i}" for i in range(40)]
    lists = [[words[(i * j) % 40] for j in range(1, 2 + i % 7)] for i in range(300)]
    chunks, queries = library(spark, *lists), asked(spark, *lists[:60])
    base = sorted(map(tuple, index.best_sections(queries, chunks, "key").collect()))
    assert base == sorted(map(tuple, index.best_sections(queries.repartition(7), chunks.repartition(11), "key", block=9).collect()))
    n, avg = 300, sum(map(len, lists)) / 300
    df = {w: sum(w in x for x in lists) for w in words}
    for q in (0, 7, 33):
        score = []
        for c, t in enumerate(lists):
            s = 0.0
            for w in lists[q]:
                if f := t.count(w):
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (f * 2.5) / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
            score.append((s, c))
        best = [c for s, c in sorted(score, reverse=True)[:3] if s > 0]
        assert [r[1] for r in sorted(base, key=lambda r: r[3]) if r[0] == q] == best


def test_empty_library(spark):
    rows = pipeline.assess(asked(spark, ["a"]), library(spark)).collect()
    assert rows[0]["coverage"] == 0.0 and rows[0]["verdict"] == "GAP"


def test_extraction_numbers_after_dropping_repeats(spark):
    text = "1. The Supplier shall do this work now.\nThe supplier shall do this work now!\n\nSomething else.\n2. The Supplier must do that work too."
    found = extract.extract(extract.doc_lines(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"))).orderBy("id").collect()
    assert [(r["id"], r["ref"], r["line_no"], r["binding"]) for r in found] == [("R-001", "1", 1, True), ("R-002", "2", 4, True)]


def test_summaries(spark):
    text = "A) Describe the whole of your plan. (max 300 words, worth 10 marks)\nB) What will the work cost you?\nThe total budget of all the work"
    lines = extract.doc_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    assert extract.grant_summary(extract.extract(lines, rules.GRANT)).first().asDict() == {"total": 3, "narrative": 1, "questions": 1, "checklist": 0, "budget": 1, "with_word_limit": 1, "with_score_weight": 1}


def test_sections(spark):
    body = "This body line is long enough to be kept as a section."
    text = f"{body}\n# First\n{body}\n{body}\n# Empty\n# Short\ntoo short;"
    rows = chunking.sections(extract.doc_lines(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).orderBy("section").collect()
    assert [(r["heading"], r["text"]) for r in rows] == [("", body), ("First", f"{body} {body}")]


def test_numbering_in_global_order(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int")
    assert [(r["v"], r["chunk_ix"]) for r in chunking.numbered(df, "v").orderBy("v").collect()] == [(i, i) for i in range(101)]


def test_thresholds_and_order(spark):
    with pytest.raises(ValueError):
        verdict.check_thresholds(0.4, 0.6)
    df = spark.createDataFrame([("R-1000", 0.3, True), ("R-101", 0.3, True), ("R-002", 0.5, False), ("R-003", 0.9, True), ("R-004", 0.1, False)], "id string, coverage double, binding boolean")
    v = verdict.verdict(F.col("coverage"))
    df = df.withColumn("verdict", v).withColumn("critical", verdict.critical(F.col("verdict"), F.col("binding")))
    assert [r["id"] for r in verdict.action_order(df).collect()] == ["R-1000", "R-101", "R-004", "R-002", "R-003"]
    assert verdict.tally(df).first().asDict() == {"answered": 1, "weak": 1, "gap": 3, "critical": 2}
    assert verdict.tally(df.limit(0)).first().asDict() == {"answered": 0, "weak": 0, "gap": 0, "critical": 0}


def test_evaluation(spark):
    a = spark.createDataFrame([("1", "GAP"), ("2", "ANSWERED"), ("3", "GAP")], "ref string, verdict string")
    labels = spark.createDataFrame([("1", "gap"), ("2", "PARTIAL"), ("3", "COVERED"), ("4", None), ("5", "GAP")], "ref string, label string")
    assert verdict.evaluation(a, labels, "ref").first().asDict() == {"gaps": 1, "gaps_found": 1, "covered": 1, "covered_found": 0, "false_confidence": 1, "false_gaps": 1, "unmatched": 1}


def test_responses_keep_every_requirement(spark):
    asked_ = spark.createDataFrame([("R-001",), ("R-002",), ("R-003",)], "id string")
    body = '{"drafts":[{"id":"R-001","answer":" old ","evidence_sufficient":true,"note":""},{"id":"R-001","answer":" new ","evidence_sufficient":true,"note":"x"},{"id":"R-999","answer":"?","evidence_sufficient":true,"note":""},{"id":"R-003","answer":"","evidence_sufficient":null,"note":null}]}'
    rows = {r["requirement_id"]: r for r in drafting.read_responses(asked_, spark.createDataFrame([(body,)], "response string")).collect()}
    assert rows["R-001"]["answer"] == "new" and rows["R-001"]["note"] == "x"
    assert not rows["R-002"]["evidence_sufficient"] and "no draft" in rows["R-002"]["note"]
    assert rows["R-003"]["evidence_sufficient"] is False and set(rows) == {"R-001", "R-002", "R-003"}


def test_gaps_never_reach_a_prompt(spark):
    chunks = spark.createDataFrame([(0, "d", "Head", "Alpha beta on file.", ["alpha", "beta"])], CHUNKS)
    q = spark.createDataFrame([(0, "R-001", "1.1", "alpha and beta", True, 1, ["alpha", "beta"]), (1, "R-002", "", "unseen secret", True, 2, ["unseen", "secret"])], "key bigint, id string, ref string, text string, binding boolean, line_no int, tokens array<string>")
    prompts = pipeline.tender_prompts(pipeline.assess(q, chunks), chunks).collect()
    assert len(prompts) == 1 and prompts[0]["ids"] == ["R-001"]
    assert "secret" not in prompts[0]["prompt"] and "[Extract 1 - d → Head]" in prompts[0]["prompt"] and "(clause 1.1)" in prompts[0]["prompt"]


def test_batches(spark):
    df = spark.createDataFrame([(f"R-{i:03d}", i) for i in range(1, 13)], "id string, line_no int").withColumn("t", F.lit("x"))
    assert [r["batch"] for r in drafting.batched(df, 5, "t").orderBy("id").collect()] == [0] * 5 + [1] * 5 + [2] * 2
    with pytest.raises(ValueError):
        drafting.batched(df, 0)


class Fake:
    def __init__(self, fails=None, says='{"drafts":[]}'):
        self.fails, self.says, self.asked = fails, says, []

    def draft(self, prompt, kind, effort="high"):
        self.asked.append((prompt, kind, effort))
        if self.fails:
            raise self.fails
        return self.says


def test_clients(spark):
    df = spark.createDataFrame([(1, "tender", ["b"], "p2"), (0, "tender", ["a"], "p1")], "batch int, kind string, ids array<string>, prompt string")
    seen, fake = [], Fake()
    assert drafting.generate(df, fake, lambda b, ids: seen.append((b, ids)), "low") == [(0, fake.says), (1, fake.says)]
    assert seen == [(0, ["a"]), (1, ["b"])] and fake.asked == [("p1", "tender", "low"), ("p2", "tender", "low")]
    cases = [
        (None, "no client", "--dry-run"), (Fake(drafting.Rejected()), "rejected", "credentials"), (Fake(drafting.RateLimited(7)), "rate limit", "7 seconds"), (Fake(drafting.RateLimited()), "rate limit", "a minute"),
        (Fake(ConnectionError("x")), "connection", "network"), (Fake(drafting.ServiceError(503, "busy")), "status", "503: busy"), (Fake(drafting.Declined()), "declined", "declined"), (Fake(RuntimeError("odd")), "failed", "odd"),
        (Fake(says=" "), "empty", "empty"), (Fake(says='{"drafts": [{"id"'), "unreadable", "JSON"), (Fake(says='[]'), "unreadable", "JSON"),
    ]
    for client, kind, said in cases:
        with pytest.raises(drafting.DraftingUnavailable) as e:
            drafting.generate(df, client)
        assert e.value.kind == kind and said in str(e.value)


def test_every_question_gets_a_local_draft(spark):
    chunks = spark.createDataFrame([(0, "d", "", "We trained the team well. The team holds skills. Other words.", ["train", "team", "hold", "skill"])], CHUNKS)
    text = "1) Describe your team and how it trained the skills. (max 40 words)\n2) What is the unknown topic about then?\n3) The budget of all that work here"
    chunks = chunks.withColumn("tokens", chunking.chunk_tokens(F.col("heading"), F.col("text")))
    scored = pipeline.with_extracts(pipeline.grant_scores(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), chunks, at=0.01), chunks)
    rows = {r["id"]: r for r in drafting.local_drafts(scored).collect()}
    assert set(rows) == {"S-001", "S-002", "S-003"} and all(r["answer"] for r in rows.values())
    assert rows["S-003"]["question_type"] == "budget" and rows["S-002"]["source_tag"] == "GENERATED" and rows["S-002"]["placeholders"]


def test_ranking_over_several_stretches(spark):
    """More sections than a task ranks at a time, with ties and repeated words: as by brute force."""
    import math
    import random

    r = random.Random(4)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 400}"
    sections = [(i, [word() for _ in range(r.randrange(0, 12))]) for i in range(9000)]
    sections += [(9000 + i, sections[i][1]) for i in range(200)]
    asked = [(i, [word() for _ in range(r.randrange(0, 6))]) for i in range(40)] + [(40, ["nowhere"]), (41, None)]
    n, avg = len(sections), sum(len(t) for _, t in sections) / len(sections)
    df = {}
    for _, t in sections:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    want = set()
    for q, t in asked:
        scored = []
        for c, held in sections:
            s = 0.0
            for w in t or []:
                if tf := held.count(w):
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len(held) / avg))
            if s > 0:
                scored.append((round(s, 9), c))
        want |= {(q, c, k) for k, (_, c) in enumerate(sorted(scored, reverse=True)[:3], 1)}
    chunks = spark.createDataFrame(sections, "chunk_ix bigint, tokens array<string>")
    queries = spark.createDataFrame(asked, "id bigint, tokens array<string>")
    for parts, block in ((1, 2_000_000), (5, 30)):
        got = {(x["id"], x["chunk_ix"], x["rank"]) for x in index.best_sections(queries, chunks.coalesce(1).repartition(parts), block=block).collect()}
        assert got == want


def test_ranking_scores_few_sections_exactly(monkeypatch):
    """A task's own work without Spark: several stretches, equal queries and sections; as by brute force, with few exact scores."""
    import random
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    r = random.Random(7)
    sections = [[f"w{int(r.paretovariate(0.8)) % 300}" for _ in range(r.randrange(0, 30))] for _ in range(3000)] + [["rare", "w1"]] * 3
    asked = [[f"w{int(r.paretovariate(0.8)) % 300}" for _ in range(r.randrange(1, 9))] for _ in range(60)]
    asked += [asked[0], ["rare", "rare", "w1"], ["nowhere"], ["w1"] * 50]
    n, avg = len(sections), sum(map(len, sections)) / len(sections)
    df = {w: sum(w in t for t in sections) for w in {w for t in sections for w in t}}
    terms = sorted(df)
    idf = np.log(1 + (n - np.array([df[w] for w in terms]) + 0.5) / (np.array([df[w] for w in terms]) + 0.5))
    place = {w: i for i, w in enumerate(terms)}
    flat, starts = np.array([place.get(w, -1) for t in asked for w in t], np.int32), np.concatenate(([0], np.cumsum([len(t) for t in asked])))
    block = SimpleNamespace(value=(terms, idf, np.arange(len(asked)) + 100, *index._once(flat, starts)))
    made, exact = [], index._exact
    monkeypatch.setattr(index, "SECTIONS", 700)
    monkeypatch.setattr(index, "_exact", lambda q, *rest: made.append(len(q)) or exact(q, *rest))
    batches = pa.table({"chunk_ix": pa.array(range(n), pa.int64()), "tokens": pa.array(sections, pa.list_(pa.string()))}).to_batches(max_chunksize=500)
    found = [row for b in index._rank((n, avg), block, 3, 1.5, 0.75)(iter(batches)) for row in zip(*(c.to_pylist() for c in b.columns))]
    want = set()
    shared = 0
    for q, t in enumerate(asked, 100):
        scored = []
        for c, held in enumerate(sections):
            s = 0.0
            for w in t:
                if tf := held.count(w):
                    s += float(idf[place[w]]) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * len(held) / avg))
            if s > 0:
                scored.append((s, c))
        shared += len(scored)
        want |= {(q, c, s) for s, c in sorted(scored, reverse=True)[:3]}
    assert set(found) == want and len(found) == len(want)
    assert sum(made) < shared / 10, (sum(made), shared)


def test_equal_queries_once_in_the_order_of_their_terms():
    import numpy as np

    lists = [[3, 0, -1], [2], [0, 3], [3, 0], [-1], [0, 1, 9], [0, 256]]
    flat, starts = np.array([t for x in lists for t in x], np.int32), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    same, terms, begins = index._once(flat, starts)
    different = [terms[i:j].tolist() for i, j in zip(begins[:-1], begins[1:])]
    assert [different[i] for i in same] == [[t for t in x if t >= 0] for x in lists]
    assert different == [[], [0, 1, 9], [0, 3], [3, 0], [0, 256], [2]] and same[0] == same[3]
