"""The two products as DataFrame plans: coverage of a tender, and scored questions of a grant call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendrel.functions import rules
from tendrel.operators import chunking, drafting, index, verdict
from tendrel.operators.extract import doc_lines, extract
from tendrel.session import materialise


def assess(requirements: DataFrame, chunks: DataFrame, answered_at: float = verdict.ANSWERED_AT, weak_at: float = verdict.WEAK_AT, key: str = "key") -> DataFrame:
    """requirements (key bigint, …, binding, tokens) with coverage, relevance, evidence, supporting, verdict, critical and
    citation, against chunks (chunk_ix, doc, heading, tokens)."""
    # both sides are read by several steps: tokens are cut once and written without the texts they came from
    requirements, chunks = materialise(requirements), materialise(chunks.select("chunk_ix", "doc", "heading", "tokens"))
    ranked = materialise(index.best_sections(requirements, chunks, key))
    covered = index.coverage(requirements, ranked, chunks, key)
    names = chunks.select(F.col("chunk_ix").alias("evidence"), chunking.citation(F.col("doc"), F.col("heading")).alias("best"))
    scored = requirements.join(covered, key).join(names, "evidence", "left")
    v = verdict.verdict(F.col("coverage"), answered_at, weak_at)
    return (
        scored.withColumn("verdict", v).withColumn("critical", verdict.critical(F.col("verdict"), F.col("binding")))
        .withColumn("citation", verdict.evidence_citation(F.col("best"), F.col("supporting"))).drop("best")
    )


def keyed(found: DataFrame, doc: str) -> DataFrame:
    """Adds key: a number of its own for each requirement, in the order of documents and lines."""
    return chunking.numbered(found, doc, "line_no", name="key")


def tender_coverage(text: DataFrame, chunks: DataFrame, answered_at: float = verdict.ANSWERED_AT, weak_at: float = verdict.WEAK_AT) -> DataFrame:
    """Coverage matrix of documents (doc_id, text) against a library, unordered; see verdict.action_order."""
    return assess(keyed(extract(doc_lines(text), rules.TENDER, with_tokens=True), "doc_id"), chunks, answered_at, weak_at)


def grant_scores(text: DataFrame, chunks: DataFrame, at: float = verdict.EVIDENCED_AT) -> DataFrame:
    """Questions of grant calls (doc_id, text) with coverage, evidence and source_tag."""
    asked = keyed(extract(doc_lines(text), rules.GRANT, with_tokens=True), "doc_id")
    return assess(asked, chunks).withColumn("source_tag", verdict.source_tag(F.col("coverage"), at)).drop("verdict", "critical")


def with_extracts(assessed: DataFrame, chunks: DataFrame, key: str = "key") -> DataFrame:
    """Adds extracts: citation and text of the best section and of supporting ones that share two terms, by rank."""
    named = chunks.select("chunk_ix", chunking.citation(F.col("doc"), F.col("heading")).alias("citation"), "text", F.col("tokens").alias("held"))
    wanted = assessed.where("evidence is not null").select(key, "tokens", F.posexplode(F.concat(F.array("evidence"), "supporting")).alias("at", "chunk_ix"))
    joined = wanted.join(named, "chunk_ix").where((F.col("at") == 0) | (F.size(F.array_intersect("held", F.array_distinct("tokens"))) >= 2))
    lists = joined.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "citation", "text"))), lambda x: F.struct(x["citation"], x["text"])).alias("extracts"))
    return assessed.join(lists, key, "left").withColumn("extracts", F.coalesce("extracts", F.array().cast("array<struct<citation:string,text:string>>")))


def tender_prompts(assessed: DataFrame, chunks: DataFrame, size: int = 5, *within: str) -> DataFrame:
    return drafting.prompts(drafting.batched(with_extracts(drafting.draftable(assessed), chunks), size, *within), *within, kind="tender")


def grant_prompts(scored: DataFrame, chunks: DataFrame, size: int = 5, *within: str) -> DataFrame:
    """Evidenced batches first, then generated ones; batch numbers run on."""
    full = with_extracts(scored, chunks)
    parts = []
    for place, (tag, kind) in enumerate((("EVIDENCED", "evidenced"), ("GENERATED", "generated"))):
        parts.append(drafting.prompts(drafting.batched(full.where(F.col("source_tag") == tag), size, *within), *within, kind=kind).withColumn("place", F.lit(place)))
    both = parts[0].unionByName(parts[1])
    number = F.row_number().over(Window.partitionBy(*within).orderBy("place", "batch")) - 1
    return both.withColumn("batch", number.cast("int")).drop("place")
