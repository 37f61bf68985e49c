"""Queries of the core operators over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.functions import rules
from tendrel.functions import text as T
from tendrel.operators import chunking, drafting, extract, index, verdict
from tendrel.plans import fixtures, pipeline
from tendrel.session import materialise, spread, table

L = "bigint"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return extract.doc_lines(documents(spark, d))


def library(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_ix, doc, heading, text, tokens) of the sections table, repeated rows once."""
    rows = table(spark, d, "chunks").where("chunk_ix is not null and text is not null").select("chunk_ix", "doc", "heading", "text").dropDuplicates(["chunk_ix"])
    return rows.withColumn("tokens", chunking.chunk_tokens(F.col("heading"), F.col("text")))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """(key, tender_id, id, text, ref, kind, binding, line_no, tokens) of the requirements table, repeated rows once."""
    rows = table(spark, d, "requirements").where("req_key is not null").dropDuplicates(["req_key"])
    return rows.select(F.col("req_key").alias("key"), "tender_id", "id", "text", "ref", "kind", "binding", "line_no", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))


def assessed(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.assess(asked(spark, d), library(spark, d))


def normalise_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).withColumn("line_no", F.col("line_no").cast(L))


def clause_ref_split(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return lines(spark, d).select("doc_id", F.col("line_no").cast(L).alias("line_no"), T.reference(line).alias("ref"), T.without_reference(line).alias("text"))


def section_ref_split(spark: SparkSession, d: str) -> DataFrame:
    line = F.col("line")
    return lines(spark, d).select("doc_id", F.col("line_no").cast(L).alias("line_no"), T.reference(line, T.SECTION_REF).alias("ref"), T.without_reference(line, T.SECTION_REF).alias("text"))


def _classified(spark: SparkSession, d: str, profile: rules.Profile) -> DataFrame:
    line = F.col("line")
    kind = rules.kind(line, T.without_reference(line, profile.ref), profile)
    return lines(spark, d).where(rules.candidate(line, profile)).select("doc_id", F.col("line_no").cast(L).alias("line_no"), kind.alias("kind")).where("kind is not null")


def classify_tender(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, rules.TENDER)


def classify_grant(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, rules.GRANT)


def extract_requirements(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(lines(spark, d)).withColumn("line_no", F.col("line_no").cast(L))


def extract_questions(spark: SparkSession, d: str) -> DataFrame:
    found = extract.extract(lines(spark, d), rules.GRANT)
    return found.select("doc_id", "id", "text", "ref", "kind", *(F.col(c).cast(L).alias(c) for c in ("word_limit", "page_limit", "line_no")), "score_weight")


def extract_summary(spark: SparkSession, d: str) -> DataFrame:
    return extract.summary(extract.extract(lines(spark, d)))


def grant_summary(spark: SparkSession, d: str) -> DataFrame:
    return extract.grant_summary(extract.extract(lines(spark, d), rules.GRANT))


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "requirements").where("text is not null").select("tender_id", T.dedupe_key(F.col("text")).alias("same"), "line_no")
    return keyed.groupBy("tender_id", "same").agg(F.min("line_no").cast(L).alias("line_no"))


def tokenise(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("key", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast(L))


def heading_segments(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(lines(spark, d)).withColumn("section", F.col("section").cast(L))


def postings_tf(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(library(spark, d))


def term_stats_idf(spark: SparkSession, d: str) -> DataFrame:
    return index.term_stats(library(spark, d)).withColumn("idf", F.round("idf", 6))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    s = index.corpus_stats(library(spark, d))
    return s.select("n", F.round("avg_len", 6).alias("avg_len"), F.round("unseen_idf", 6).alias("unseen_idf"))


def top3_evidence(spark: SparkSession, d: str) -> DataFrame:
    ranked = index.best_sections(asked(spark, d), materialise(library(spark, d).select("chunk_ix", "tokens")), "key")
    return ranked.select("key", "chunk_ix", F.col("rank").cast(L).alias("rank"), F.round("score", 6).alias("score"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    a = assessed(spark, d)
    return a.select("key", F.round("coverage", 6).alias("coverage"), F.round("relevance", 6).alias("relevance"), "evidence", "verdict", "critical", "citation")


def tally(spark: SparkSession, d: str) -> DataFrame:
    return verdict.tally(assessed(spark, d))


def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The whole matrix in action order."""
    a = verdict.action_order(assessed(spark, d), "tender_id")
    return a.select("tender_id", "id", "ref", verdict.obligation(F.col("binding")).alias("obligation"), "verdict", "critical", F.round("coverage", 6).alias("coverage"), "text", "citation", F.col("line_no").cast(L).alias("line_no"))


def documents_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Requirements found in the documents themselves, against the library: the product from end to end."""
    a = pipeline.tender_coverage(documents(spark, d), library(spark, d))
    return a.select("doc_id", "id", "ref", "kind", "binding", F.round("coverage", 6).alias("coverage"), "verdict", "critical", "evidence", F.col("line_no").cast(L).alias("line_no"))


def grant_source_tags(spark: SparkSession, d: str) -> DataFrame:
    g = pipeline.grant_scores(documents(spark, d), library(spark, d))
    return g.select("doc_id", "id", "kind", F.round("coverage", 6).alias("coverage"), "source_tag")


def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return verdict.evaluation(assessed(spark, d), table(spark, d, "coverage_labels"), "tender_id", "ref")


def draftable(spark: SparkSession, d: str) -> DataFrame:
    return drafting.draftable(assessed(spark, d)).select("key", "verdict", "evidence")


def draft_batches(spark: SparkSession, d: str) -> DataFrame:
    return drafting.batched(asked(spark, d), 5, "tender_id").select("tender_id", "id", F.col("batch").cast(L).alias("batch"))


def prompt_preview(spark: SparkSession, d: str) -> DataFrame:
    made = pipeline.tender_prompts(assessed(spark, d), library(spark, d), 5, "tender_id")
    return made.withColumn("batch", F.col("batch").cast(L)).withColumn("ids", F.array_join("ids", ", "))


def draft_parse_left_join(spark: SparkSession, d: str) -> DataFrame:
    """The drafts table as responses, one JSON text per tender, read back against every requirement."""
    rows = table(spark, d, "tender_drafts").where("draft_id is not null").dropDuplicates(["draft_id"])
    entry = F.struct("draft_id", F.struct(F.col("requirement_id").alias("id"), "answer", "evidence_sufficient", "note").alias("e"))
    listed = rows.groupBy("tender_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("drafts"))
    responses = listed.select("tender_id", F.to_json(F.struct("drafts"), {"ignoreNullFields": "false"}).alias("response"))
    return drafting.read_responses(asked(spark, d).select("tender_id", "id"), responses, "tender_id")


def drafts_on_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How the drafts on file meet the verdicts: drafts by verdict and whether they call their evidence sufficient."""
    rows = table(spark, d, "tender_drafts").where("draft_id is not null").dropDuplicates(["draft_id"])
    a = assessed(spark, d).select("tender_id", F.col("id").alias("requirement_id"), "verdict")
    return rows.join(a, ["tender_id", "requirement_id"]).groupBy("verdict", F.coalesce("evidence_sufficient", F.lit(False)).alias("sufficient")).agg(F.count("*").alias("drafts"))


def question_type(spark: SparkSession, d: str) -> DataFrame:
    found = extract.extract(lines(spark, d), rules.GRANT)
    return found.select("doc_id", "id", rules.question_type(F.col("kind"), F.col("text")).alias("question_type"), F.col("text").rlike(rules.NEEDS_SPECIFICS).alias("needs_specifics"))


def topic_phrase(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(lines(spark, d), rules.GRANT).select("doc_id", "id", T.topic(F.col("text")).alias("topic"))


def key_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The best sentences of the cited section of each requirement."""
    a = assessed(spark, d).where("evidence is not null").select("key", "evidence", F.array_distinct("tokens").alias("wanted"))
    texts = library(spark, d).select(F.col("chunk_ix").alias("evidence"), "text")
    return a.join(texts, "evidence").select("key", F.posexplode(T.key_sentences(F.col("text"), F.col("wanted"))).alias("place", "sentence")).withColumn("place", F.col("place").cast(L))


def local_drafts(spark: SparkSession, d: str) -> DataFrame:
    chunks = library(spark, d)
    scored = pipeline.with_extracts(pipeline.grant_scores(documents(spark, d), chunks), chunks)
    return drafting.local_drafts(scored).select("doc_id", "id", "source_tag", "question_type", "answer", F.array_join("placeholders", "; ").alias("placeholders"), "note")


def garble_gate(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, d).where("text is not null").select("doc_id", T.looks_garbled(t).alias("garbled"), F.round(T.readable_share(t), 6).alias("readable"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    return library(spark, d).select("chunk_ix", chunking.citation(F.col("doc"), F.col("heading")).alias("citation"))


def skipped_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files that could not be read, by suffix and reason; a null reason counts as one."""
    s = table(spark, d, "skipped").where("name is not null")
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return s.groupBy(suffix.alias("suffix"), F.coalesce("reason", F.lit("(none)")).alias("reason")).agg(F.count("*").alias("files"))


def report_slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tenders").where("title is not null").select("tender_id", T.slug(F.col("title")).alias("slug"), T.trimmed_cell(F.col("title"), 40).alias("cell"))


def reader_files(spark: SparkSession, d: str) -> DataFrame:
    """Every reader on made files with known texts and failures; the test tables hold no files."""
    return fixtures.read_all(spark)


def rules_at_edges(spark: SparkSession, d: str) -> DataFrame:
    """The rules on made rows where easy readings of them go wrong."""
    return fixtures.rules_at_edges(spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        normalise_lines, clause_ref_split, section_ref_split, classify_tender, classify_grant, extract_requirements, extract_questions, extract_summary, grant_summary, dedupe_first, tokenise,
        heading_segments, postings_tf, term_stats_idf, corpus_stats, top3_evidence, coverage, tally, coverage_matrix, documents_coverage, grant_source_tags, eval_metrics, draftable, draft_batches,
        prompt_preview, draft_parse_left_join, drafts_on_gaps, question_type, topic_phrase, key_sentences, local_drafts, garble_gate, citations, skipped_reasons, report_slugs, reader_files, rules_at_edges,
    )
    return {f.__name__: f for f in all_}
