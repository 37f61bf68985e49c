"""Problem 2: leftovers of HTML, Markdown, wiki and LaTeX source in text."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

#: Element names, attributes without a value, and LaTeX commands that stand without an argument.
_TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col dd del div dl dt em figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label legend li link main mark meta nav ol option p pre q s samp script section select "
    "small span strike strong style sub sup table tbody td textarea tfoot th thead title tr tt u ul var video"
).split()
_BARE = "checked disabled hidden nowrap noshade compact selected readonly required controls"
_COMMANDS = "item hline maketitle noindent centering newline newpage par today ldots dots quad qquad toprule midrule bottomrule LaTeX TeX leq geq times cdot alpha beta sum infty pm"

_TAG = rf"</?(?:{'|'.join(_TAGS)})(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)|\s+(?:{_BARE.replace(' ', '|')}))*\s*/?>"
TAG = re.compile(_TAG, re.I)
ENTITY = re.compile(r"&(?:#\d{2,6}|#[xX][0-9a-fA-F]{2,5}|[A-Za-z][A-Za-z0-9]{1,30});")


def _is_entity(m: re.Match) -> bool:
    return html.unescape(m.group()) != m.group()


_HTML = re.compile(rf"{_TAG}|<!--.*?-->|<!DOCTYPE", re.I | re.S)
_EMPHASIS = r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]+)(?<=[^\s*])\1(?![\w*])|(?<![\w_\\])(_{1,3})(?=[^\s_])([^_\n]+)(?<=[^\s_])\3(?![\w_])"
EMPHASIS = re.compile(_EMPHASIS)
STRUCK = re.compile(r"~~(?=[^\s~])([^~\n]+)(?<=[^\s~])~~")
CODE_SPAN = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)")
IMAGE = re.compile(r"!\[([^\]\[\n]*)\](?:\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|\[[^\]\[\n]*\])")
LINK = re.compile(r"\[([^\]\[\n]+)\](?:\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|\[[^\]\[\n]*\])")
FENCE = re.compile(r"^[ \t]{0,3}(```+|~~~+)[ \t]*[\w+-]*[ \t]*(?=\r?$|\s)", re.M)
ATX = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*\r?$", re.M)
SETEXT = re.compile(r"^(?=.*\w)(?![ \t]*(?:[-*+>|]|\d+[.)]) )([^\n|]{1,120}\S)[ \t]*\r?\n[ \t]{0,3}(?:-{3,}|={3,})[ \t]*\r?$", re.M)
TASK = re.compile(r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]+", re.M)
QUOTE = re.compile(r"^[ \t]{0,3}>[ \t]+(?=\S)", re.M)
DELIMITER_ROW = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\r?$|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*\r?$", re.M)
#: Signs of Markdown alone; a heading's # at the start of a line is a list item in wiki pages.
_MARKDOWN = (EMPHASIS, STRUCK, CODE_SPAN, IMAGE, LINK, FENCE, SETEXT, TASK, QUOTE, DELIMITER_ROW)

WIKI_LINK = re.compile(r"\[\[(?:([^\[\]\n|]*)\|)?(?:[^\[\]\n|]*\|)*([^\[\]\n|]*)\]\]")
TEMPLATE = re.compile(r"\{\{\s*([#A-Za-z][\w -]*)\s*(?:\|((?:[^{}]|\{\{[^{}]*\}\})*))?\}\}")
QUOTES = re.compile(r"('{2,5})(?=[^'\s])([^\n]+?)\1")
WIKI_HEAD = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*\r?$", re.M)
CONFLUENCE_HEAD = re.compile(r"^[ \t]*h([1-6])\.[ \t]+(?=\S)", re.M)
MACRO = re.compile(r"(?<!\\begin)(?<!\\end)\{(?:code|noformat|quote|panel|info|note|tip|warning|color|toc|expand|section|column)(?:[:=][^{}\n]*)?\}")
WIKI_TABLE = re.compile(r"^[ \t]*(?:\{\|.*|\|\}|\|-+)[ \t]*\r?$", re.M)
WIKI_CELLS = re.compile(r"^[ \t]*\|\|?.*\|\|.*$", re.M)
NESTED = re.compile(r"^[ \t]*(?:\*{2,5}|[*#]*(?:\*#|#\*)[*#]*)[ \t]+(?![^\n]*\*\*)(?=\S)", re.M)
_WIKI = (WIKI_LINK, TEMPLATE, QUOTES, WIKI_HEAD, CONFLUENCE_HEAD, MACRO, WIKI_TABLE, WIKI_CELLS)

COMMAND = re.compile(rf"(?<![\w:\\/])~?\\(?:[a-zA-Z]{{2,}}\*?(?=[\[{{])|(?:{_COMMANDS.replace(' ', '|')})(?![a-zA-Z\\]))|\\(?:frac|cite|ref|label|footnote|textbf|emph|begin|end|item)(?=[\[{{ ])")
MATH = re.compile(r"\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s\d$])(?=[^$\n]*[\\^_={}])[^$\n]+(?<=[^\s])\$(?![\w$])|\\\((?:(?!\\[()])[^\n])+\\\)|\\\[(?:(?!\\[\[\]]).)+\\\]", re.S)
ROW_END = re.compile(r"(?<!\\)\\\\(?:\[[^\]\n]*\])?[ \t]*\r?$", re.M)
ESCAPED = re.compile(r"(?<![\\\w:]\\)(?<![A-Za-z]:)\\([%&_#$])(?!\w)")
_LATEX = (COMMAND, MATH, ROW_END, ESCAPED)


def _own_signs(text: str) -> list[str]:
    """The languages of which text holds a sign that no other one has."""
    found = []
    if ("<" in text and _HTML.search(text)) or ("&" in text and any(_is_entity(m) for m in ENTITY.finditer(text))):
        found.append("html")
    if any(p.search(text) for p in _MARKDOWN):
        found.append("markdown")
    if any(p.search(text) for p in _WIKI) or NESTED.search(text):
        found.append("wiki")
    if ("\\" in text or "$" in text) and any(p.search(text) for p in _LATEX):
        found.append("latex")
    return found


def kinds(text: str) -> list[str]:
    """Which markup languages text holds at least one sign of; a sign that two languages share is its block's."""
    found = set(_own_signs(text))
    if ATX.search(text):
        # only in a text that is wiki elsewhere can the sign be another language's
        found |= {lang for start, end, _, lang in label_blocks(text) if ATX.search(text[start:end])} if "wiki" in found else {"markdown"}
    return [k for k in KINDS if k in found]


# -- blocks -----------------------------------------------------------------------------------------------------

#: Frequent function words of the languages at hand, for the density of running text.
STOPWORDS = frozenset(
    "a an and are as at be by for from has have in is it of on or our that the their this to was we were which will with you your "
    "au aux avec ce dans de des du en est et la le les par pas pour qui sur un une "
    "das dem den der die ein eine für im ist mit nicht und von wie zu zum "
    "al como con del el es los las para por que se su una y".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_LINKED = re.compile(rf"{IMAGE.pattern}|{LINK.pattern}|<a\b[^>]*>.*?</a>|{WIKI_LINK.pattern}|https?://\S+", re.I | re.S)
#: Lines of signs that say nothing by themselves: rules, stars, hashes, bars and list signs.
_AMBIGUOUS = re.compile(r"^[ \t]*(?:[-*_=~]{3,}|[*#>|:;]{1,6}(?:[ \t].*)?|[-+] .*|\d+[.)] .*)\r?$")
#: Rows of cells and list items hold what belongs to the text, however many links that is.
_STRUCTURE = re.compile(r"^[ \t]*(?:[-*+•|]|\d+[.)]|#)")

PROSE, MARKED, FURNITURE, SHORT = "prose", "mark-up", "furniture", "short"
#: Density of stop words and length from which a line is running text, and share of links from which it may be furniture.
PROSE_STOPS, PROSE_SIZE, LINKS = 0.12, 60, 0.5


def _features(block: str) -> tuple[float, int, float, int]:
    """(stop-word density, length in characters, link density, links)."""
    words = _WORD.findall(block.lower())
    stop = sum(w in STOPWORDS for w in words) / len(words) if words else 0.0
    links = [len(m.group()) for m in _LINKED.finditer(block)] if "[" in block or "<" in block or "://" in block else []
    return stop, len(block), sum(links) / len(block) if block else 0.0, len(links)


def _nearest(decided: list[int], i: int) -> int | None:
    """The decided line nearest to line i, the earlier of two at the same distance."""
    at = bisect_left(decided, i)
    return min(decided[max(0, at - 1) : at + 1], key=lambda j: (abs(j - i), j), default=None)


def label_blocks(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, role, language) of the lines of text.

    First pass, by stop-word density, length, link density and signs: long lines dense in stop words are prose; lines of
    several links and little else are furniture (menus, paths of links); other lines with signs of their own are mark-up.
    Of these the language is that of their signs, and none for prose without any. Short lines of a single link, and lines
    whose signs several languages share (hashes, stars, rules, bars), stay undecided.

    Second pass: each undecided line takes role and language of the nearest decided line, the earlier of two at the same
    distance. A shared sign next to prose, or without any decided line, is read as Markdown's where Markdown has it.
    """
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, at + len(line), line))
        at += len(line)
    roles: list[str | None] = []
    langs: list[str | None] = []
    # a heading and the rule below it are one sign
    underlined = [m.span() for m in SETEXT.finditer(text)]
    for begin, _, line in lines:
        bare = line.strip()
        stop, size, linked, links = _features(bare)
        own = ["markdown"] if any(a <= begin < b for a, b in underlined) else _own_signs(line) if bare else []
        shared = bool(_AMBIGUOUS.match(line)) and not own
        prose = stop >= PROSE_STOPS and size >= PROSE_SIZE
        if linked > LINKS and stop < PROSE_STOPS and not _STRUCTURE.match(line):
            roles.append(FURNITURE if links > 1 and size > 40 else None)
        else:
            roles.append(PROSE if prose and not shared else MARKED if own else SHORT)
        langs.append(own[0] if own else None if shared and bare else "" if prose else "?")
    decided = [i for i, x in enumerate(langs) if x is not None and x != "?" and roles[i] != FURNITURE]
    settled = [i for i, x in enumerate(roles) if x in (PROSE, MARKED, FURNITURE)]
    out = []
    for i, (start, end, line) in enumerate(lines):
        lang, role = langs[i], roles[i]
        if lang is None:
            near = _nearest(decided, i)
            lang = (langs[near] if near is not None else "") or ("markdown" if ATX.match(line.rstrip("\r\n")) else "")
        if role is None:
            near = _nearest(settled, i)
            role = FURNITURE if near is not None and roles[near] == FURNITURE else MARKED
        out.append((start, end, role, "" if lang == "?" else lang))
    return out


# -- conversion ---------------------------------------------------------------------------------------------------


def _from_html(text: str) -> str:
    text = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", text, flags=re.I | re.S)
    text = re.sub(r"<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(.*?)(?:</code>)?\s*</pre>", lambda m: "\n```\n" + m.group(1).strip("\n") + "\n```\n", text, flags=re.I | re.S)

    def rows(m: re.Match) -> str:
        cells = re.split(r"</?t[dh]\b[^>]*>", m.group(1), flags=re.I)
        return "\n" + " | ".join(c.strip() for c in cells if c.strip())

    text = re.sub(r"<tr\b[^>]*>(.*?)(?:</tr>|(?=<tr\b)|(?=</table>)|$)", rows, text, flags=re.I | re.S)
    text = re.sub(r"\s*<h([1-6])\b[^>]*>\s*(.*?)\s*</h\1>\s*", lambda m: "\n" + "#" * int(m.group(1)) + " " + m.group(2) + "\n", text, flags=re.I | re.S)
    text = re.sub(r"\s*<li\b[^>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"<sup\b[^>]*>(.*?)</sup>", r"^\1", text, flags=re.I | re.S)
    text = re.sub(r"<sub\b[^>]*>(.*?)</sub>", r"_\1", text, flags=re.I | re.S)
    text = re.sub(r"<br\s*/?>", "\n", text, flags=re.I)
    text = re.sub(r"</?(?:p|div|blockquote|ul|ol|table|tbody|thead|section|article|header|footer|h[1-6]|pre|hr|dl|dt|dd|form|title|li)\b[^<>]*>", "\n", text, flags=re.I)
    text = TAG.sub("", text)
    text = ENTITY.sub(lambda m: html.unescape(m.group()), text)
    return TAG.sub("", text) if TAG.search(text) else text


def _from_markdown(text: str) -> str:
    text = SETEXT.sub(lambda m: "# " + m.group(1).strip(), text)
    text = ATX.sub(lambda m: m.group(1) + " " + m.group(2), text)
    text = DELIMITER_ROW.sub("\x00", text)
    text = re.sub(r"^[ \t]*\|(.*?)\|?[ \t]*\r?$", lambda m: " | ".join(c.strip() for c in m.group(1).split("|")), text, flags=re.M)
    text = TASK.sub(lambda m: "- ", text)
    text = re.sub(r"^([ \t]*)[*+] (?=\S)", r"\1- ", text, flags=re.M)
    text = QUOTE.sub("", text)
    text = re.sub(r"^[ \t]*(?:\*{3,}|-{3,}|_{3,})[ \t]*\r?$", "\x00", text, flags=re.M)
    for _ in range(3):
        text = EMPHASIS.sub(lambda m: m.group(2) or m.group(4), text)
    text = CODE_SPAN.sub(r"\2", STRUCK.sub(r"\1", text))
    return re.sub(r"\x00\r?\n?", "", LINK.sub(r"\1", IMAGE.sub(r"\1", text)))


def _from_wiki(text: str) -> str:
    text = re.sub(r"\{(code|noformat)(?:[:=][^{}\n]*)?\}\s*(.*?)\s*\{\1\}", lambda m: "\n```\n" + m.group(2) + "\n```\n", text, flags=re.S)
    text = re.sub(r"^[ \t]*([*#]{1,6})[ \t]+(?=\S)", lambda m: "  " * (len(m.group(1)) - 1) + "- ", text, flags=re.M)
    text = WIKI_HEAD.sub(lambda m: "#" * (len(m.group(1)) - 1) + " " + m.group(2), text)
    text = CONFLUENCE_HEAD.sub(lambda m: "#" * int(m.group(1)) + " ", text)
    text = re.sub(r"^[ \t]*(?:\{\|.*|\|\}|\|-+)[ \t]*\r?$\n?", "", text, flags=re.M)
    text = re.sub(r"^[ \t]*\|\|?(.*)$", lambda m: " | ".join(c.strip() for c in m.group(1).strip("| ").split("||")), text, flags=re.M)

    def template(m: re.Match) -> str:
        name, body = m.group(1).strip().lower(), m.group(2) or ""
        if name == "math":
            return "$" + body.replace("{{=}}", "=") + "$"
        return body.rsplit("|", 1)[-1]

    text = text.replace("{{=}}", "=")
    for _ in range(3):
        text = TEMPLATE.sub(template, text)
    text = WIKI_LINK.sub(lambda m: m.group(2) or m.group(1) or "", text)
    text = MACRO.sub("", text)
    for _ in range(2):
        text = QUOTES.sub(r"\2", text)
    return text


_ARGUMENT = r"\{((?:[^{}]|\{[^{}]*\})*)\}"


def _from_latex(text: str) -> str:
    kept: list[str] = []

    def keep(body: str) -> str:
        kept.append(body)
        return f"\x01{len(kept) - 1}\x02"

    text = re.sub(r"\\begin\{(verbatim|lstlisting)\}(?:\[[^\]]*\])?\n?(.*?)\n?\\end\{\1\}", lambda m: "\n" + keep("```\n" + m.group(2) + "\n```") + "\n", text, flags=re.S)
    text = re.sub(r"\\begin\{(equation|align|displaymath|eqnarray)\*?\}\s*(.*?)\s*\\end\{\1\*?\}", lambda m: "\n" + keep("$$ " + m.group(2) + " $$") + "\n", text, flags=re.S)
    text = re.sub(r"\\\[\s*((?:(?!\\[\[\]]).)+?)\s*\\\]", lambda m: keep("$$ " + m.group(1) + " $$"), text, flags=re.S)
    text = re.sub(r"\\\(((?:(?!\\[()]).)+)\\\)", lambda m: keep("$" + m.group(1) + "$"), text)
    text = MATH.sub(lambda m: keep(m.group()), text)
    text = re.sub(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?" + _ARGUMENT, lambda m: "\n" + "#" * (1 + 1 * ("sub" in m.group(1)) + m.group(1).count("subsub")) + " " + m.group(2), text)
    text = re.sub(r"~?\\(?:cite|label|index|vspace|hspace|includegraphics)\w*\*?(?:\[[^\]]*\])?" + _ARGUMENT, "", text)
    text = re.sub(r"\s*\((?:see )?\\(?:page)?ref" + _ARGUMENT + r"\)|\\(?:page)?ref" + _ARGUMENT, "", text)
    text = re.sub(r"\\footnote" + _ARGUMENT, r" (\1)", text)
    text = re.sub(r"^(.*?)\\\\(?:\[[^\]]*\])?[ \t]*\r?$", lambda m: " | ".join(c.strip() for c in re.split(r"(?<!\\)&", m.group(1))) if "&" in m.group(1) else m.group(1), text, flags=re.M)
    text = re.sub(r"[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: "- " + (m.group(1) + " " if m.group(1) else ""), text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\]|\{[^{}]*\})*[ \t]*\n?", "", text)
    for _ in range(3):
        text = re.sub(r"\\[a-zA-Z]{2,}\*?(?:\[[^\]]*\])?" + _ARGUMENT, r"\1", text)
    text = re.sub(rf"\\(?:{_COMMANDS.replace(' ', '|')})(?![a-zA-Z\\])[ \t]*", "", text)
    text = ESCAPED.sub(r"\1", text)
    return re.sub("\x01(\\d+)\x02", lambda m: kept[int(m.group(1))], text)


_CONVERT = {"latex": _from_latex, "wiki": _from_wiki, "markdown": _from_markdown, "html": _from_html}


def clean(text: str) -> tuple[str, list[str]]:
    """(clean text, markup languages found). Headings come out as #, list items as -, table rows with bars between
    cells, code between fences and formulas between dollar signs; menus of links are left out and everything else is plain.
    Text without markup comes out as it is."""
    found = kinds(text)
    if not found:
        return text, found
    used = [k for k in ("html", "latex", "wiki", "markdown") if k in found]
    parts: list[str] = []
    for part, lang in _runs(text, label_blocks(text)):
        own = _own_signs(part)
        for kind in used:
            # signs that several languages share are read as the language of their block
            if kind in (lang, *own):
                part = _protected(part, _CONVERT[kind])
        parts.append(part)
    out = "".join(parts)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n)|(?<=\S)[ \t]{2,}(?=\S)", lambda m: "" if not m.group() or m.end() < len(out) and out[m.end()] == "\n" else " ", out)).strip("\n"), found


def _runs(text: str, blocks: list[tuple[int, int, str, str]]) -> Iterator[tuple[str, str]]:
    """Stretches of lines of one language, without furniture; plain lines join the stretch they stand in, for markup
    spans lines."""
    blocks = [b for b in blocks if b[2] != FURNITURE]
    i = 0
    while i < len(blocks):
        lang, j = blocks[i][3], i + 1
        while j < len(blocks) and (not lang or blocks[j][3] in (lang, "")):
            lang = lang or blocks[j][3]
            j += 1
        yield "".join(text[start:end] for start, end, *_ in blocks[i:j]), lang
        i = j


def _protected(text: str, convert) -> str:
    """Convert everything but fenced code."""
    parts = re.split(r"(^(?:```|~~~)[^\n]*\n.*?^(?:```|~~~)[ \t]*$\n?)", text, flags=re.M | re.S)
    return "".join(re.sub("^~~~", "```", p, flags=re.M) if i % 2 else convert(p) for i, p in enumerate(parts))


#: Every sign of kinds() has one of these, as test_prefilter_covers_conversion has it; text without any of them holds no markup; it is passed over before Python.
CANDIDATE = r"(?m)<[/!A-Za-z]|&[#A-Za-z]\w*;|[*_]\S|[`\\{$]|~~|\]\(|\]\[|\[\[|''|==|^[ \t]*(?:[#>|~=]|h[1-6]\.[ \t]|[-*+][ \t]+\[[ xX]\])|---|-{2,}[ \t:]*\|"


def markup_texts(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, markup, clean) of every row whose text holds markup; markup is the list of languages found.

    Null and plain texts give no row; null keys are kept; repeated rows (equal keys) come once; other columns are
    ignored. Rows are judged on their own, so nothing is shuffled before those found.
    """
    named = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found, cleaned = [], [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                plain, languages = clean(t)
                if languages:
                    rows.append(i)
                    found.append(languages)
                    cleaned.append(plain)
            took = b.select(list(range(len(keys)))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(found, pa.list_(pa.string())), pa.array(cleaned, pa.string())], [*keys, "markup", "clean"])

    rows = df.where(F.col(text).rlike(CANDIDATE)).select(*keys, text)
    return rows.mapInArrow(run, ", ".join([*named, "markup array<string>, clean string"])).dropDuplicates(list(keys))
