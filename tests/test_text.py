import pytest
from pyspark.sql import functions as F

from tendrel.functions import rules
from tendrel.functions import text as T


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [
    ("The Supplier shall hold ISO 27001 certification.", ["hold", "iso", "certification"]),
    ("services service processes process", ["servic", "service", "process", "proces"]),
    ("policies series patches encrypted testing", ["policy", "sery", "patch", "encrypt", "test"]),
    ("hours days access bring", ["hour", "days", "acces", "bring"]),
    ("AES-256 24x7 c++ ISO/IEC", ["aes-256", "x7", "c++", "iso", "iec"]),
    ("", []),
    ("27001 24 7", []),
])
def test_tokens(spark, text, want):
    assert value(spark, text, T.tokens) == want


def test_lines_fold_every_kind_of_blank(spark):
    assert value(spark, " a\xa0 b \r\n\r\n\tc\x0bd  e", T.lines) == ["a b", "c", "d", "e"]
    assert value(spark, None, T.lines) is None
    assert value(spark, " \n ", T.lines) == []


@pytest.mark.parametrize("line, ref, rest", [
    ("4.1.3 | The Supplier shall provide cover daily.", "4.1.3", "The Supplier shall provide cover daily."),
    ("12 months of support shall be included here.", "12", "months of support shall be included here."),
    ("SR-14) Provide cover", "SR-14", "Provide cover"),
    ("No reference here", "", "No reference here"),
])
def test_clause_reference(spark, line, ref, rest):
    assert value(spark, line, T.reference) == ref
    assert value(spark, line, T.without_reference) == rest


def test_section_reference_needs_its_terminator(spark):
    ref = lambda c: T.reference(c, T.SECTION_REF)
    assert value(spark, "Question 3.1) How?", ref) == "Question 3.1"
    assert value(spark, "3.1 How?", ref) == ""


def test_limits_and_weights(spark):
    line = "Describe it. (max 300 words, worth 10 marks) up to 2 pages"
    assert value(spark, line, T.word_limit) == 300
    assert value(spark, line, T.page_limit) == 2
    assert value(spark, line, T.score_weight) == "worth 10 marks"
    assert value(spark, "no limit", T.word_limit) is None
    assert value(spark, "20% weighting", T.score_weight) == "20% weighting"


def classify(spark, line, profile=rules.TENDER):
    df = spark.createDataFrame([(line,)], "line string")
    c = F.col("line")
    return df.where(rules.candidate(c, profile)).select(rules.kind(c, T.without_reference(c, profile.ref), profile).alias("k")).first()


@pytest.mark.parametrize("line, want", [
    ("4.1.3 | The Supplier shall provide cover daily.", "row"),
    ("Question | Answer and more", None),
    ("5.1 Describe your incident response process.", "question"),
    ("Suppliers should hold insurance cover today.", "clause"),
    ("Do you hold certification?", "question"),
    ("12 months of support shall be included here.", "clause"),
    ("Nothing is asked for in this line.", None),
])
def test_tender_lines(spark, line, want):
    row = classify(spark, line)
    assert (row["k"] if row else None) == want


@pytest.mark.parametrize("line", ["Page 4 of 22 of", "3. Requirements .......... 14", "short one", "GENERAL TERMS AND CONDITIONS"])
def test_no_candidates(spark, line):
    row = classify(spark, line)
    assert row is None or row["k"] is None


@pytest.mark.parametrize("line, want", [
    ("Tell us what the work is about please.", "narrative"),
    ("What is it? Say more of it here.", "question"),
    ("The budget and all of its parts", "budget"),
    ("Costs | Describe them in this cell", "checklist"),
])
def test_grant_lines(spark, line, want):
    assert classify(spark, line, rules.GRANT)["k"] == want


def test_headings_slugs_cells(spark):
    for line, want in (("# any line at all, however long it is;", True), ("Service Desk", True), ("École élémentaire", True), ("Service Desk:", False), ("lower case", False)):
        assert value(spark, line, T.is_heading) is want
    assert value(spark, "A b/ü.md", T.slug) == "a-b-ü-md"
    assert value(spark, "///", T.slug) == "report"
    assert value(spark, "a|b" * 4, lambda c: T.trimmed_cell(c, 9)) == "a\\|ba\\|b…"


def test_key_sentences_keep_order_among_equals(spark):
    text = "Alpha beta gamma. Beta gamma. Nothing here. Gamma beta delta alpha."
    got = value(spark, text, lambda c: T.key_sentences(c, F.array(*map(F.lit, ("alpha", "beta", "gamma")))))
    assert got == ["Alpha beta gamma.", "Gamma beta delta alpha.", "Beta gamma."]


def test_garble_gate(spark):
    assert value(spark, "short", T.looks_garbled) is True
    assert value(spark, "Plain prose that anyone can read without any trouble at all.", T.looks_garbled) is False
    assert value(spark, "@#$%" * 30, T.looks_garbled) is True


def test_empty_texts_are_garbled_without_a_share(spark):
    assert value(spark, "", T.looks_garbled) is True
    assert value(spark, "", T.readable_share) is None
    assert value(spark, " " * 50, T.readable_share) == 1.0


def test_question_type_takes_the_first_match(spark):
    kind = lambda c: rules.question_type(F.lit("narrative"), c)
    assert value(spark, "Describe your team and its relevant experience", kind) == "experience"
    assert value(spark, "Who is on the team?", kind) == "team"
    assert value(spark, "How are risks met?", kind) == "default"
