"""Which lines ask for something: patterns as data, one classification for both products."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tendrel.functions.text import CLAUSE_REF, SECTION_REF, word_count

#: Fixed values.
BINDING = r"(?i)\b(shall|must|is\s+required\s+to|are\s+required\s+to|will\s+be\s+required)\b"
ADVISORY = r"(?i)\b(should|may|is\s+expected\s+to|preferred|desirable)\b"
REQUEST = r"(?i)^(describe|explain|outline|detail|provide|confirm|state|list|specify|demonstrate|summaris[ez]e|set\s+out|give\s+details)\b"
PROMPT = (
    r"(?i)\b(describe|explain|outline|detail|provide|confirm|state|list|specify|demonstrate|summaris[ez]e|set\s+out|give\s+details|tell\s+us|show\s+how"
    r"|evidence|justify|indicate|illustrate|identify|what\s+is\s+your|how\s+will\s+you|how\s+do\s+you|what\s+are\s+your|what\s+steps|what\s+measures"
    r"|please\s+provide|please\s+describe|please\s+explain)\b"
)
PROMPT_AT_START = PROMPT.replace(r"(?i)\b(", "(?i)^(")
BUDGET = r"(?i)\b(budget|cost|expenditure|financial\s+plan|funding\s+breakdown)\b"
CONTENTS_DOTS = r"\.{4,}\s*\d+\s*$"
PAGE_NUMBER = r"(?i)^(page\s+)?\d+(\s+of\s+\d+)?$"
CAPITALS = r"^[A-Z0-9 ,&/()-]{4,}$"

#: Kind of question -> words, first match wins; the ends in \b are meant.
QUESTION_TYPES = (
    ("experience", r"(?i)\b(experience|track record|organisation|background|relevant)\b"),
    ("problem", r"(?i)\b(problem|need|challenge|issue|gap|who benefits)\b"),
    ("solution", r"(?i)\b(solution|approach|proposed|innovative|how does it work)\b"),
    ("impact", r"(?i)\b(impact|measure|success|evaluat|kpi|performance indicator)\b"),
    ("sustainability", r"(?i)\b(sustain|beyond|after|continue|route to market|adoption)\b"),
    ("risk", r"(?i)\b(risk|mitigat|contingenc)\b"),
    ("team", r"(?i)\b(team|staff|personnel|qualif|skills|capacity)\b"),
    ("plan", r"(?i)\b(plan|milestone|timeline|deliverable|schedule|phase)\b"),
)
NEEDS_SPECIFICS = r"(?i)\b(how|detail|specific|evidence|demonstrate)\b"


@dataclass(frozen=True)
class Profile:
    """What one product looks for."""

    name: str
    ref: str
    id_format: str
    keeps_capitals: str  # a line in capitals stays if it matches this
    asks: str  # a table cell asks if it matches this at its start
    row_anywhere: str  # or the row if it matches this
    row_kind: str
    question_inside: bool  # a question mark inside the text makes a question too


TENDER = Profile("tender", CLAUSE_REF, "R-%03d", BINDING, REQUEST, BINDING, "row", False)
GRANT = Profile("grant", SECTION_REF, "S-%03d", PROMPT, PROMPT_AT_START, PROMPT, "checklist", True)


def candidate(line: Column, profile: Profile) -> Column:
    """Long enough, no table of contents, page number or capital heading."""
    return (F.length(line) >= 15) & ~line.rlike(CONTENTS_DOTS) & ~line.rlike(PAGE_NUMBER) & ~(line.rlike(CAPITALS) & ~line.rlike(profile.keeps_capitals))


def kind(line: Column, text: Column, profile: Profile) -> Column:
    """The kind of requirement or question, null for neither. line: as it stands; text: without its reference."""
    words = word_count(text)
    cells = F.transform(F.split(line, r"\|"), F.trim)
    asking = F.exists(cells, lambda c: c.endswith("?") | c.rlike(profile.asks)) | line.rlike(profile.row_anywhere)
    question = text.endswith("?") | (text.rlike(r"\?\s") if profile.question_inside else F.lit(False))
    found = F.when(line.contains(" | "), F.when(asking & (words >= 4), profile.row_kind)).when(question & (words >= 4), "question").when(words < 5, F.lit(None))
    if profile is GRANT or profile.name == GRANT.name:
        return found.when(text.rlike(PROMPT), "narrative").when(text.rlike(BUDGET), "budget")
    return found.when(text.rlike(REQUEST), "question").when(text.rlike(BINDING) | text.rlike(ADVISORY), "clause")


def question_type(kind_: Column, text: Column) -> Column:
    found = F.when(kind_ == "budget", "budget")
    for name, pattern in QUESTION_TYPES:
        found = found.when(text.rlike(pattern), name)
    return found.otherwise("default")
