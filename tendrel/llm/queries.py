"""Queries of the operators in this package, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.llm import cutoff, drafts, enrichment, markup, mixture, mojibake, neardup, packing, split
from tendrel.llm.common import limits
from tendrel.session import table


def both_tables(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """(tab, rec_id, column) of chunks and requirements."""
    chunks = table(spark, sf_dir, "chunks").select(F.lit("chunks").alias("tab"), F.col("chunk_ix").alias("rec_id"), column)
    return chunks.unionByName(table(spark, sf_dir, "requirements").select(F.lit("requirements").alias("tab"), F.col("req_key").alias("rec_id"), column))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term of greatest tf-idf of each record, out of the operator's scored terms."""
    return enrichment.best_term(enrichment.distinctive_terms(both_tables(spark, sf_dir, "tokens")), "tf_idf")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every record with its enrichment score."""
    scored = enrichment.distinctive_terms(both_tables(spark, sf_dir, "tokens"))
    each = scored.select("tab", "rec_id", F.explode(F.arrays_zip("term", "tf", "records", "score", "tf_idf")).alias("t"))
    return each.select("tab", "rec_id", "t.term", "t.tf", "t.records", F.round("t.score", 6).alias("score"), F.round("t.tf_idf", 6).alias("tf_idf"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.markup_texts(both_tables(spark, sf_dir, "text"), "tab", "rec_id")
    return found.select("tab", "rec_id", F.explode("markup").alias("markup"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_texts(both_tables(spark, sf_dir, "text"), "tab", "rec_id").select("tab", "rec_id", "clean")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts.broken_drafts(table(spark, sf_dir, "tender_drafts"), table(spark, sf_dir, "requirements"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_texts(both_tables(spark, sf_dir, "text"), "tab", "rec_id").select("tab", "rec_id")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_texts(both_tables(spark, sf_dir, "text"), "tab", "rec_id")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = limits(spark, sf_dir)
    return split.split_oversized(table(spark, sf_dir, "chunks"), limit=int(fixed["item_max"]), overlap=int(fixed["item_overlap"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 1").select("chunk_ix")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p5_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each section must hold to: (chunk_ix, characters covered, whether all fit, share no more than
    the overlap, and follow each other without a gap)."""
    fixed, pieces = limits(spark, sf_dir), _pieces(spark, sf_dir)
    each = pieces.groupBy("chunk_ix").agg(
        F.sum(F.col("end") - F.col("start")).alias("covered"), (F.max(F.length("piece")) <= int(fixed["item_max"])).alias("fits"),
        (F.max(F.col("start") - F.col("shared_from")) <= int(fixed["item_overlap"])).alias("overlaps"), F.min("start").alias("low"), F.max("end").alias("high"),
        (F.max("piece_no") == F.count("*")).alias("numbered"),
    )
    gapless = (F.col("low") == 0) & (F.col("high") == F.col("covered")) & F.col("numbered")
    return each.select("chunk_ix", "covered", "fits", "overlaps", gapless.alias("gapless"))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_pairs(table(spark, sf_dir, "chunks"), threshold=limits(spark, sf_dir)["near_duplicate_min"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.expand_pairs(*_near(spark, sf_dir)).toDF("chunk_a", "chunk_b")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_ix, group_id, links): the group of each section in terms of its least chunk_ix."""
    links, classes = _near(spark, sf_dir)
    return neardup.groups(links, classes).withColumnRenamed("id", "chunk_ix")


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_ix, rep, copies): the least chunk_ix with the same text and how many have it; with it p6_found's links stand
    for all members' pairs."""
    classes = neardup.text_classes(table(spark, sf_dir, "chunks"), "chunk_ix", "text")
    return classes.join(classes.groupBy("rep").agg(F.count("*").alias("copies")), "rep").select(F.col("id").alias("chunk_ix"), "rep", "copies")


def _containers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    capacity = int(limits(spark, sf_dir)["container_capacity"])
    return packing.fill_containers(table(spark, sf_dir, "documents"), capacity), capacity


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(*_containers(spark, sf_dir))


def p7_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers must hold to: (doc_id, whether every part of it is there once, and whether its containers hold
    no more than the capacity and only texts above it are parted)."""
    filled, capacity = _containers(spark, sf_dir)
    used = filled.groupBy("container_id").agg(F.sum("tokens").alias("inside"))
    each = filled.join(used, "container_id").groupBy("doc_id").agg(
        ((F.count("*") == F.max("part")) & (F.countDistinct("part") == F.max("part"))).alias("once"),
        ((F.max("inside") <= capacity) & (F.max(F.col("used") - F.col("inside")) == 0) & (F.sum("tokens") > (F.max("part") - 1) * capacity)).alias("fits"),
    )
    return each.select("doc_id", "once", "fits")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_sources"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_sources"))[1]


def p8_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mixture must hold to: (source, whether no text comes more often than allowed, and whether the source gives
    its share as the others do: to a hundredth or its longest text, or all its repeats)."""
    report = p8_shares(spark, sf_dir)
    whole = report.agg(F.sum("given").alias("all"), F.sum("size").alias("sizes"))
    each = report.join(F.broadcast(whole))
    full = F.col("given") + F.col("longest") >= F.col("size") * F.col("max_repeats")
    # every source that isn't full gets its target in proportion to the others that aren't
    ratio = F.col("given") / (F.col("target_share") * F.col("all"))
    level = each.where(~full).agg(F.expr("percentile(given / (target_share * all), 0.5)").alias("level"))
    near = F.abs(ratio - F.col("level")) * F.col("target_share") * F.col("all") <= F.greatest(F.col("longest"), F.col("given") * 0.01)
    return each.join(F.broadcast(level)).select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), (full | near | (F.col("size") == 0)).alias("shared"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_off(table(spark, sf_dir, "documents")).where("truncated").select("doc_id")


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.source_rates(cutoff.cut_off(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_found, p1_terms, p2_found, p2_clean, p3_found, p4_found, p4_restored, p5_found, p5_pieces, p5_cover, p6_found, p6_groups, p6_members,
        p7_containers, p7_fill, p7_once, p8_mixture, p8_shares, p8_caps, p9_found, p9_sources,
    )
    return {f.__name__: f for f in found}
