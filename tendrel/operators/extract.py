"""Lines of documents, and the requirements or questions among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendrel.functions import rules
from tendrel.functions import text as T


def doc_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): normalised non-empty lines numbered from 1. No shuffle; null texts give no line."""
    return docs.select(key, F.posexplode(T.lines(F.col(text))).alias("pos", "line")).select(key, (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def extract(lines: DataFrame, profile: rules.Profile = rules.TENDER, key: str = "doc_id", with_tokens: bool = False) -> DataFrame:
    """(key, id, text, ref, kind, binding, line_no [, tokens]) of every requirement; for questions of grant calls also
    word_limit, page_limit and score_weight.

    Order matters: candidates are classified, then the first line of equal keys is kept, then numbers are given. All
    three run in one shuffle by document, after every line that asks for nothing is gone.
    """
    line = F.col("line")
    found = (
        lines.where(rules.candidate(line, profile))
        .select(key, "line_no", "line", T.reference(line, profile.ref).alias("ref"), T.without_reference(line, profile.ref).alias("text"))
        .withColumn("kind", rules.kind(line, F.col("text"), profile)).where("kind is not null")
        .withColumn("same", T.dedupe_key(F.col("text")))
    )
    first = F.row_number().over(Window.partitionBy(key, "same").orderBy("line_no"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    # partitioning by the document alone serves both windows with one exchange
    kept = found.repartition(key).withColumn("first", first).where("first = 1").withColumn("n", number)
    columns: list[Column | str] = [key, F.format_string(profile.id_format, "n").alias("id"), "text", "ref", "kind", F.col("text").rlike(rules.BINDING).alias("binding"), "line_no"]
    if profile.name == rules.GRANT.name:
        columns += [T.word_limit(line).alias("word_limit"), T.page_limit(line).alias("page_limit"), T.score_weight(line).alias("score_weight")]
    if with_tokens:
        columns.append(T.tokens(F.col("text")).alias("tokens"))
    return kept.select(*columns)


def summary(found: DataFrame) -> DataFrame:
    """(total, binding, advisory, questions) of requirements."""
    b = F.col("binding")
    return found.agg(
        F.count("*").alias("total"), F.count_if(b).alias("binding"), F.count_if(~b).alias("advisory"), F.count_if(F.col("kind") == "question").alias("questions")
    )


def grant_summary(found: DataFrame) -> DataFrame:
    k = F.col("kind")
    return found.agg(
        F.count("*").alias("total"), *(F.count_if(k == v).alias(n) for n, v in (("narrative", "narrative"), ("questions", "question"), ("checklist", "checklist"), ("budget", "budget"))),
        F.count_if(F.col("word_limit") > 0).alias("with_word_limit"), F.count_if(F.col("score_weight") != "").alias("with_score_weight"),
    )
