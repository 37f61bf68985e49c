"""The fixed values that the SQL goes by, stated here a second time so that a slip in the library shows against it."""

from __future__ import annotations

from types import SimpleNamespace

ANSWERED_AT, WEAK_AT, EVIDENCED_AT = 0.62, 0.42, 0.45

#: Fixed values.
text = SimpleNamespace(
    LINE_BREAK=r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]",
    BLANKS=r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+",
    WORD_LIMIT=r"(?i)(?:max(?:imum)?|up\s+to|no\s+more\s+than|limit[: ]*)\s*(\d{2,5})\s*words?",
    PAGE_LIMIT=r"(?i)(?:max(?:imum)?|up\s+to|no\s+more\s+than|limit[: ]*)\s*(\d{1,2})\s*pages?",
    SCORE_WEIGHT=r"(?i)(?:worth|weighted?|scores?|marks?|points?)[: ]*\s*(\d{1,3})\s*(?:%|marks?|points?|/)",
    SCORE_WEIGHT_AFTER=r"(?i)(\d{1,3})\s*(?:%|marks?|points?)\s*(?:weighting|weight|of\s+total)",
    NO_TOPIC="describe explain provide detail how what your will you the a an is are of in to and for with that this does do its by".split(),
    STOPWORDS=(
        "a accordance additional affected aforementioned agreed all also an and any applicable apply appropriate are as "
        "associated at authority basis be bear been being bidder but by can case condition conditions confirm contract "
        "contractor current deliver describe detail did do does duration each ensure event exceeding for from had has "
        "have herein hereunder how if in include includes including into is it its least less maximum may means minimum "
        "must no not of on or other our outline parties party per please prior proposal provide relevant require "
        "required requirement requirements requires respond response said shall should so state submit such supplier "
        "suppliers tenderer term terms than that the their then there thereafter these they this those throughout to "
        "undertake us vendor vendors via was we were what when where whereby which who will with within would written "
        "you your"
    ).split(),
)

_BINDING = r"(?i)\b(shall|must|is\s+required\s+to|are\s+required\s+to|will\s+be\s+required)\b"
_REQUEST = r"(?i)^(describe|explain|outline|detail|provide|confirm|state|list|specify|demonstrate|summaris[ez]e|set\s+out|give\s+details)\b"
_ASKING = (
    r"describe|explain|outline|detail|provide|confirm|state|list|specify|demonstrate|summaris[ez]e|set\s+out|give\s+details|tell\s+us|show\s+how"
    r"|evidence|justify|indicate|illustrate|identify|what\s+is\s+your|how\s+will\s+you|how\s+do\s+you|what\s+are\s+your|what\s+steps|what\s+measures"
    r"|please\s+provide|please\s+describe|please\s+explain"
)
#: Fixed values.
rules = SimpleNamespace(
    BINDING=_BINDING,
    ADVISORY=r"(?i)\b(should|may|is\s+expected\s+to|preferred|desirable)\b",
    REQUEST=_REQUEST,
    PROMPT=rf"(?i)\b({_ASKING})\b",
    BUDGET=r"(?i)\b(budget|cost|expenditure|financial\s+plan|funding\s+breakdown)\b",
    CONTENTS_DOTS=r"\.{4,}\s*\d+\s*$",
    PAGE_NUMBER=r"(?i)^(page\s+)?\d+(\s+of\s+\d+)?$",
    CAPITALS=r"^[A-Z0-9 ,&/()-]{4,}$",
    NEEDS_SPECIFICS=r"(?i)\b(how|detail|specific|evidence|demonstrate)\b",
    QUESTION_TYPES=(
        ("experience", r"(?i)\b(experience|track record|organisation|background|relevant)\b"),
        ("problem", r"(?i)\b(problem|need|challenge|issue|gap|who benefits)\b"),
        ("solution", r"(?i)\b(solution|approach|proposed|innovative|how does it work)\b"),
        ("impact", r"(?i)\b(impact|measure|success|evaluat|kpi|performance indicator)\b"),
        ("sustainability", r"(?i)\b(sustain|beyond|after|continue|route to market|adoption)\b"),
        ("risk", r"(?i)\b(risk|mitigat|contingenc)\b"),
        ("team", r"(?i)\b(team|staff|personnel|qualif|skills|capacity)\b"),
        ("plan", r"(?i)\b(plan|milestone|timeline|deliverable|schedule|phase)\b"),
    ),
    TENDER=SimpleNamespace(
        ref=r"^((?:[A-Z]{1,4}[-.])?\d+(?:\.\d+)*[a-z]?)[.):\]]?\s+", id_format="R-%03d", keeps_capitals=_BINDING, asks=_REQUEST, row_anywhere=_BINDING, row_kind="row", question_inside=False
    ),
    GRANT=SimpleNamespace(
        ref=r"^(?i:((?:section\s+|q(?:uestion)?\s*)?(?:[A-Z]{0,4}[-.])?\d+(?:\.\d+)*[a-z]?)[.):\]]\s+)", id_format="S-%03d", keeps_capitals=rf"(?i)\b({_ASKING})\b", asks=rf"(?i)^({_ASKING})\b",
        row_anywhere=rf"(?i)\b({_ASKING})\b", row_kind="checklist", question_inside=True,
    ),
)
