"""Sections of library documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendrel.functions import text as T
from tendrel.session import materialise


def sections(lines: DataFrame, key: str = "doc_id", least: int = 40) -> DataFrame:
    """(key, section, heading, text): the body lines under each heading joined by spaces, from `least` characters on.

    section is the running number of the heading (0 before the first). One shuffle by document: the window's
    partitioning serves the grouping too.
    """
    running = F.sum(F.col("head").cast("int")).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("head", T.is_heading(F.col("line"))).withColumn("section", running.cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda x: x["line"]), " ")
    return (
        marked.groupBy(key, "section").agg(F.coalesce(F.max(F.when(F.col("head"), T.heading_text(F.col("line")))), F.lit("")).alias("heading"), F.trim(body).alias("text"))
        .where(F.length("text") >= least)
    )


def chunk_tokens(heading: Column, text: Column) -> Column:
    """The heading counts as text, so that its words are found."""
    return T.tokens(F.concat_ws(" ", heading, text))


def citation(doc: Column, heading: Column) -> Column:
    return F.when(F.coalesce(heading, F.lit("")) == "", doc).otherwise(F.concat(doc, F.lit(" → "), heading))


def numbered(df: DataFrame, *order: str, name: str = "chunk_ix") -> DataFrame:
    """Rows numbered from 0 in a global order without gathering them: a range partitioning is sorted and written, and
    each partition's numbers begin where the counts of those before it end (one small row per partition)."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = materialise(sorted_)
    part = F.shiftright("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    return (
        kept.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at")
    )
