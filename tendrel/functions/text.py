"""Text expressions as Columns: lines, references, tokens, limits and the like. All run in the JVM; those over arrays are
interpreted by Spark, the others are part of generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks and blanks as Python's str.splitlines and str.split see them, spelled out for Java and RE2 alike.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: Words that carry no evidence, looked up before stemming.
STOPWORDS = (
    "a accordance additional affected aforementioned agreed all also an and any applicable apply appropriate are as "
    "associated at authority basis be bear been being bidder but by can case condition conditions confirm contract "
    "contractor current deliver describe detail did do does duration each ensure event exceeding for from had has "
    "have herein hereunder how if in include includes including into is it its least less maximum may means minimum "
    "must no not of on or other our outline parties party per please prior proposal provide relevant require "
    "required requirement requirements requires respond response said shall should so state submit such supplier "
    "suppliers tenderer term terms than that the their then there thereafter these they this those throughout to "
    "undertake us vendor vendors via was we were what when where whereby which who will with within would written "
    "you your"
).split()

#: References in front of a clause (terminator optional) and of a question (terminator needed).
CLAUSE_REF = r"^((?:[A-Z]{1,4}[-.])?\d+(?:\.\d+)*[a-z]?)[.):\]]?\s+"
SECTION_REF = r"^(?i:((?:section\s+|q(?:uestion)?\s*)?(?:[A-Z]{0,4}[-.])?\d+(?:\.\d+)*[a-z]?)[.):\]]\s+)"
#: Limits and weights in questions.
WORD_LIMIT = r"(?i)(?:max(?:imum)?|up\s+to|no\s+more\s+than|limit[: ]*)\s*(\d{2,5})\s*words?"
PAGE_LIMIT = r"(?i)(?:max(?:imum)?|up\s+to|no\s+more\s+than|limit[: ]*)\s*(\d{1,2})\s*pages?"
SCORE_WEIGHT = r"(?i)(?:worth|weighted?|scores?|marks?|points?)[: ]*\s*(\d{1,3})\s*(?:%|marks?|points?|/)"
SCORE_WEIGHT_AFTER = r"(?i)(\d{1,3})\s*(?:%|marks?|points?)\s*(?:weighting|weight|of\s+total)"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def collapse(text: Column) -> Column:
    """Runs of blanks become one space, outer ones go."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def stripped(text: Column) -> Column:
    """Without outer blanks of any kind."""
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def lines(text: Column) -> Column:
    """The normalised non-empty lines of a text, in order."""
    return F.filter(F.transform(F.split(text, LINE_BREAK), collapse), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Words of a text whose blanks are collapsed."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def reference(text: Column, pattern: str = CLAUSE_REF) -> Column:
    return F.regexp_extract(text, pattern, 1)


def without_reference(text: Column, pattern: str = CLAUSE_REF) -> Column:
    """The text behind its reference; a cell bar stranded in front goes with it."""
    return F.when(F.regexp_extract(text, pattern, 0) != "", F.trim(F.regexp_replace(F.regexp_replace(text, pattern, ""), r"^[| ]+", ""))).otherwise(text)


def dedupe_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def stem(word: Column) -> Column:
    """First matching ending only: ing, ed, ies (to y), es, s."""
    n = F.length(word)
    return (
        F.when(word.endswith("ing") & (n > 5), word.substr(F.lit(1), n - 3))
        .when(word.endswith("ed") & (n > 5), word.substr(F.lit(1), n - 2))
        .when(word.endswith("ies") & (n > 5), F.concat(word.substr(F.lit(1), n - 3), F.lit("y")))
        .when(word.endswith("es") & (n > 5), word.substr(F.lit(1), n - 2))
        .when(word.endswith("s") & (n > 4), word.substr(F.lit(1), n - 1))
        .otherwise(word)
    )


def tokens(text: Column) -> Column:
    """Stemmed words in order, repeats kept: lower-case runs that begin with a letter, without outer dots and dashes, of
    two characters or more, no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9+#.-]*"), 0)
    bare = F.transform(found, lambda w: F.btrim(w, F.lit(".-")))
    return F.transform(F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS)), stem)


def word_limit(text: Column) -> Column:
    return _found(text, WORD_LIMIT, 1).try_cast("int")


def page_limit(text: Column) -> Column:
    return _found(text, PAGE_LIMIT, 1).try_cast("int")


def score_weight(text: Column) -> Column:
    """The whole match of the first pattern that fits, or ''."""
    return F.coalesce(_found(text, SCORE_WEIGHT, 0), _found(text, SCORE_WEIGHT_AFTER, 0), F.lit(""))


def is_heading(line: Column) -> Column:
    """Starts with #, or up to eight words, an upper-case start and no closing sign."""
    return line.startswith("#") | ((word_count(line) <= 8) & ~F.substring(line, -1, 1).isin(".", ";", ":", "?") & line.rlike(r"^\p{Lu}"))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, "^[# ]+", ""))


def slug(name: Column) -> Column:
    """File name of a report folder."""
    made = F.lower(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", ""))
    return F.when(made == "", "report").otherwise(made)


def trimmed_cell(text: Column, limit: int) -> Column:
    """For a table cell: bars escaped first, then cut to the limit with an ellipsis."""
    escaped = F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.when(F.length(escaped) > limit, F.concat(F.rtrim(F.substring(escaped, 1, limit - 1)), F.lit("…"))).otherwise(escaped)


def shortened(text: Column, limit: int) -> Column:
    """Cut to one less than the limit, without blanks at the cut and with three dots behind it."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("..."))).otherwise(text)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])" + BLANKS)


#: Words that name no topic.
NO_TOPIC = "describe explain provide detail how what your will you the a an is are of in to and for with that this does do its by".split()


def topic(question: Column) -> Column:
    """Up to five words a question is about, without its limits; '' if none."""
    bare = F.regexp_replace(F.regexp_replace(question, r"(?i)\(max \d+ words.*?\)", ""), r"(?i)\(worth \d+ marks.*?\)", "")
    stop = F.array(*[F.lit(w) for w in NO_TOPIC])
    words = F.filter(F.split(collapse(F.lower(bare)), " "), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2))
    return F.array_join(F.slice(words, 1, 5), " ")


def key_sentences(text: Column, wanted: Column, most: int = 4, least: int = 2) -> Column:
    """The sentences that share most words with wanted, best first, ties in order."""
    scored = F.transform(
        sentences(text),
        lambda s, i: F.struct((-F.size(F.array_intersect(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), 0), wanted))).alias("minus"), i.alias("at"), F.trim(s).alias("s")),
    )
    return F.transform(F.slice(F.array_sort(F.filter(scored, lambda x: x["minus"] <= -least)), 1, most), lambda x: x["s"])


def readable_share(text: Column) -> Column:
    """Share of letters, blanks (no-break ones too) and .,;:()/- in the first 4000 characters; neither digits nor marks
    that combine with a letter are readable by this measure. Null for an empty text."""
    head = F.substring(text, 1, 4000)
    return F.length(F.regexp_replace(head, r"[^\p{L}" + BLANKS[1:-2] + r".,;:()/-]", "")) / F.nullif(F.length(head), F.lit(0))


def looks_garbled(text: Column) -> Column:
    """Too short to judge (under 40 characters) or under three quarters readable."""
    return (F.length(F.substring(text, 1, 4000)) < 40) | (readable_share(text) < 0.75)
