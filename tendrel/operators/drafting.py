"""Drafting: what may be drafted, prompts in batches, reading responses, and drafts from own material."""

from __future__ import annotations

import json
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendrel.functions import rules
from tendrel.functions import text as T

TENDER_RESPONSE = "struct<drafts:array<struct<id:string,answer:string,evidence_sufficient:boolean,note:string>>>"
GRANT_RESPONSE = "struct<drafts:array<struct<id:string,answer:string,placeholders:array<string>,note:string>>>"


class DraftingUnavailable(Exception):
    """Drafting ended before all batches were answered; kind tells why, the message what to do."""

    def __init__(self, message: str, kind: str = "failed"):
        super().__init__(message)
        self.kind = kind


class Rejected(Exception):
    """For clients: the credentials were not accepted."""


class RateLimited(Exception):
    """For clients: too many requests; retry_after in seconds, if the service said so."""

    def __init__(self, retry_after: float | None = None):
        super().__init__(f"retry after {retry_after}")
        self.retry_after = retry_after


class ServiceError(Exception):
    """For clients: the service answered with an error status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message)
        self.status = status


class Declined(Exception):
    """For clients: the service would not respond to this prompt."""


EFFORTS = ("low", "medium", "high")


class DraftClient(Protocol):
    """Turns a prompt into a response (JSON of TENDER_RESPONSE or GRANT_RESPONSE); `kind` tells which instructions apply,
    `effort` is one of EFFORTS. Failures are told by the exceptions above, ConnectionError and TimeoutError."""

    def draft(self, prompt: str, kind: str, effort: str = "high") -> str: ...


def draftable(assessed: DataFrame) -> DataFrame:
    """Answered or weak, with evidence; gaps never get into a prompt."""
    return assessed.where(F.col("verdict").isin("ANSWERED", "WEAK") & F.col("evidence").isNotNull())


def batched(df: DataFrame, size: int = 5, *within: str, order: str = "line_no") -> DataFrame:
    """Adds batch: consecutive groups of `size` in order, within each of `within`."""
    if size < 1:
        raise ValueError("batch size must be at least 1")
    place = F.row_number().over(Window.partitionBy(*within).orderBy(order, "id"))
    return df.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def prompts(df: DataFrame, *within: str, kind: str = "tender") -> DataFrame:
    """(within, batch, kind, ids, prompt): one prompt per batch of (id, ref, text, extracts array<struct<citation,text>>).

    kind tender and evidenced list numbered extracts; generated asks without any. word_limit and score_weight are
    used where the kind has them.
    """
    ref = F.when(F.coalesce("ref", F.lit("")) != "", F.concat(F.lit(" ("), F.lit("clause " if kind == "tender" else ""), "ref", F.lit(")"))).otherwise("")
    head = F.concat(F.lit("### "), "id", ref, F.lit("\n"), F.lit("Requirement: " if kind == "tender" else "Question: "), "text")
    if kind != "tender":
        head = F.concat(head, F.coalesce(F.concat(F.lit("\nWord limit: "), F.col("word_limit").cast("string")), F.lit("")))
    if kind == "generated":
        head = F.concat(head, F.when(F.coalesce("score_weight", F.lit("")) != "", F.concat(F.lit("\nScoring: "), "score_weight")).otherwise(""))
        block = head
    else:
        extracts = F.array_join(F.transform("extracts", lambda e, i: F.concat(F.lit("[Extract "), (i + 1).cast("string"), F.lit(" - "), e["citation"], F.lit("]\n"), e["text"])), "\n\n")
        block = F.concat(head, F.lit("\n\nExtracts on file:\n"), extracts)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "id", block.alias("block"))))
    return df.groupBy(*within, "batch").agg(parts.alias("p")).select(
        *within, "batch", F.lit(kind).alias("kind"), F.transform("p", lambda x: x["id"]).alias("ids"), F.array_join(F.transform("p", lambda x: x["block"]), "\n\n---\n\n").alias("prompt")
    )


def read_responses(asked: DataFrame, responses: DataFrame, *within: str, schema: str = TENDER_RESPONSE) -> DataFrame:
    """One draft per asked (within, id): the last of its id in the response of its batch (within, response as JSON),
    unknown ids ignored; ids without an answer come out as insufficient with a note, never dropped."""
    each = responses.select(*within, F.posexplode(F.from_json("response", schema)["drafts"]).alias("pos", "d"))
    last = each.groupBy(*within, F.col("d.id").alias("id")).agg(F.max_by("d", "pos").alias("d"))
    d = F.col("d")
    return asked.select(*within, "id").join(last, [*within, "id"], "left").select(
        *within, F.col("id").alias("requirement_id"), T.stripped(F.coalesce(d["answer"], F.lit(""))).alias("answer"),
        *([F.coalesce(d["evidence_sufficient"], F.lit(False)).alias("evidence_sufficient")] if schema == TENDER_RESPONSE else [F.coalesce(d["placeholders"], F.array().cast("array<string>")).alias("placeholders")]),
        F.when(d.isNull(), "The response holds no draft for this requirement.").otherwise(T.stripped(F.coalesce(d["note"], F.lit("")))).alias("note"),
    )


def _unavailable(e: Exception) -> DraftingUnavailable:
    """One kind of error with a remedy for whatever a client throws."""
    if isinstance(e, Rejected):
        return DraftingUnavailable("the credentials were rejected; check them and sign in again", "rejected")
    if isinstance(e, RateLimited):
        wait = "a minute" if e.retry_after is None else f"{e.retry_after:g} seconds"
        return DraftingUnavailable(f"too many requests; retry in {wait} or use a smaller batch size", "rate limit")
    if isinstance(e, ServiceError):
        return DraftingUnavailable(f"the service reports error {e.status}: {e}", "status")
    if isinstance(e, Declined):
        return DraftingUnavailable("the service declined to respond; look through the texts of this batch and retry", "declined")
    if isinstance(e, (ConnectionError, TimeoutError)):
        return DraftingUnavailable("the service can't be reached; check the network and retry", "connection")
    return DraftingUnavailable(str(e), "failed")


def _checked(response: str | None) -> str:
    if not response or not response.strip():
        raise DraftingUnavailable("the response is empty; a smaller batch may help", "empty")
    try:
        found = json.loads(response)
    except ValueError:
        found = None
    if not isinstance(found, dict) or not isinstance(found.get("drafts"), list):
        raise DraftingUnavailable("the response can't be read; it is no list of drafts in JSON, and may have been cut short", "unreadable")
    return response


def generate(batches: DataFrame, client: DraftClient | None, progress=None, effort: str = "high") -> list[tuple[int, str]]:
    """Sends prompts in order, one at a time, and returns (batch, response); the first failure ends all, so that no
    half-finished set is taken for a whole one."""
    if client is None:
        raise DraftingUnavailable("no draft client is set up; use --dry-run to see the prompts", "no client")
    out = []
    for row in batches.orderBy("batch").toLocalIterator():
        if progress:
            progress(row["batch"], row["ids"])
        try:
            out.append((row["batch"], _checked(client.draft(row["prompt"], row["kind"], effort))))
        except DraftingUnavailable as e:
            raise DraftingUnavailable(f"batch {row['batch']}: {e}", e.kind) from None
        except Exception as e:  # whatever a client throws, callers see one kind of error
            told = _unavailable(e)
            raise DraftingUnavailable(f"batch {row['batch']}: {told}", told.kind) from e
    return out


#: Own wording: type of question -> (paragraphs, what has to be filled in). {topic} is the question's topic, {question} its text cut short.
TEMPLATES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "experience": (("[PLACEHOLDER: organisation] has worked on {topic} for [PLACEHOLDER: years] years.", "Comparable work: [PLACEHOLDER: past projects and their results]."), ("Organisation", "Years", "Past projects")),
    "problem": (("The problem is [PLACEHOLDER: problem]; it affects [PLACEHOLDER: who and how many].", "What exists today falls short because [PLACEHOLDER: reason]."), ("Problem", "Who is affected", "Why today's answers fall short")),
    "solution": (("We propose [PLACEHOLDER: solution in a sentence], which works by [PLACEHOLDER: how].", "New in it is [PLACEHOLDER: what is new], shown by [PLACEHOLDER: earlier work]."), ("Solution", "How it works", "What is new", "Earlier work")),
    "impact": (("Success is measured by [PLACEHOLDER: measures and targets].", "We evaluate with [PLACEHOLDER: methods]."), ("Measures and targets", "Methods")),
    "sustainability": (("After the funding ends, [PLACEHOLDER: what carries on and how].", "It reaches its users through [PLACEHOLDER: route and partners]."), ("What carries on", "Route and partners")),
    "risk": (("Risks, how likely and grave they are, and what we do: [PLACEHOLDER: a row for each risk].",), ("Risks and what is done about them",)),
    "team": (("[PLACEHOLDER: lead] leads the work with [PLACEHOLDER: members and their skills].",), ("Lead", "Members and skills")),
    "plan": (("The work has [PLACEHOLDER: number] phases: [PLACEHOLDER: dates, activities and results of each].",), ("Phases", "Activities and results")),
    "budget": (
        (
            "| Cost | Amount | Why it is needed |\n|---|---|---|\n"
            + "\n".join(f"| {line} | [PLACEHOLDER: amount] | [PLACEHOLDER: {why}] |" for line, why in (("Staff", "roles and their share of time"), ("Equipment", "what for"), ("Subcontracts", "who does what"), ("Travel", "journeys"), ("Other", "details")))
            + "\n| Total | [PLACEHOLDER: amount] | |",
            "[PLACEHOLDER: why these costs are needed and give value for money]",
        ),
        ("Staff costs and shares of time", "Equipment and what it is for", "Subcontracts", "Travel", "Total", "Why this is value for money"),
    ),
    "default": (("[PLACEHOLDER: answer to: {question}]", "[PLACEHOLDER: evidence, examples or data]"), ("Answer", "Evidence")),
}


def local_drafts(scored: DataFrame) -> DataFrame:
    """(…, answer, placeholders, note) without any client, for (text, kind, tokens, word_limit, source_tag, extracts).

    Evidenced questions get the sentences of their sections that share most words with them, cut to three paragraphs
    over the word limit; all others a template by the type of question. Every question gets a draft.
    """
    kind = rules.question_type(F.col("kind"), F.col("text"))
    topic = F.coalesce(F.nullif(T.topic(F.col("text")), F.lit("")), F.lit("this area"))
    spark = scored.sparkSession
    table = spark.createDataFrame([(k, list(p), list(f)) for k, (p, f) in TEMPLATES.items()], "question_type string, paragraphs array<string>, fill array<string>")
    quoted = F.filter(F.transform("extracts", lambda e: F.array_join(T.key_sentences(e["text"], F.col("tokens")), " ")), lambda p: p != "")
    own = F.concat(F.array(F.lit("Earlier work on file answers this as follows.")), quoted)
    words = lambda parts: T.word_count(T.collapse(F.array_join(parts, " ")))
    evidenced = (F.col("source_tag") == "EVIDENCED") & (F.size("extracts") > 0)
    specific = F.col("text").rlike(rules.NEEDS_SPECIFICS)
    capped = F.when(words(own) > F.col("word_limit"), F.slice(own, 1, 3)).otherwise(own)
    more = F.lit("[PLACEHOLDER: figures, dates and commitments for this call]")
    written = F.when(evidenced, F.concat(capped, F.when(specific, F.array(more)).otherwise(F.array().cast("array<string>"))))
    filled = F.transform("paragraphs", lambda p: F.replace(F.replace(p, F.lit("{topic}"), F.col("topic")), F.lit("{question}"), T.shortened(F.col("text"), 100)))
    short = (kind != "budget") & (words(filled) < F.col("word_limit") * 0.5)
    hint = F.array(F.concat(F.lit("[PLACEHOLDER: expand to about "), F.col("word_limit").cast("string"), F.lit(" words]")))
    template = F.concat(filled, F.when(short, hint).otherwise(F.array().cast("array<string>")))
    return (
        scored.withColumn("question_type", kind).withColumn("topic", topic).join(F.broadcast(table), "question_type")
        .withColumn("answer", F.array_join(F.coalesce(written, template), "\n\n"))
        .withColumn("placeholders", F.when(evidenced, F.when(specific, F.array(more)).otherwise(F.array().cast("array<string>"))).otherwise(F.col("fill")))
        .withColumn("note", F.when(evidenced, "From past material; check and adapt.").otherwise("A template; fill in every placeholder."))
        .drop("paragraphs", "fill", "topic")
    )
