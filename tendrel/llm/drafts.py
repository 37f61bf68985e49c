"""Problem 3: broken pairs of requirement and draft answer."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendrel.llm.common import once
from tendrel.llm.language import language, votes
from tendrel.llm.markup import clean
from tendrel.llm.refusals import _SENTENCE, is_refusal, words

# -- no statement ---------------------------------------------------------------------------------------------------

#: Stand-ins for an answer, compared in lower case without outer punctuation.
STAND_INS = frozenset(
    "n/a|na|n.a|not applicable|none|null|nil|nan|tbd|tbc|tba|to be done|to be decided|to be determined|to be confirmed|to be completed|to be advised|to follow|"
    "follows|pending|blank|empty|xxx|xx|xxxx|todo|answer|response|answer here|insert answer|your answer|no answer|nothing|see above|see below|lorem ipsum|"
    "à compléter|à suivre|réponse|néant|sans objet|s.o|folgt|offen|entfällt|k. a|k.a|antwort|keine angabe|keine|pendiente|por definir|respuesta|ninguno|ninguna|no aplica|à définir".split("|")
)
_BLANK = re.compile("[\\s​‌‍⁠﻿­ㅤ\xa0]+")
_TAGS = re.compile(r"<[^<>]*>")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    text = _BLANK.sub(" ", html.unescape(_TAGS.sub(" ", answer))).strip()
    core = text.strip(" .,:;!?-–—_*/\\()[]{}<>\"'“”…#=|").lower()
    if not re.search(r"\w", core) or core in STAND_INS or re.fullmatch(r"x+|0+|(\w)\1{2,}", core):
        return True
    return bool(re.fullmatch(r"[\[({<]\s*(?:placeholder|insert|add|todo|tbd|answer)\b[^\[\](){}<>]*[\])}>]", text, re.I))


# -- copies -------------------------------------------------------------------------------------------------------------

#: What may introduce or follow a copied requirement without saying anything, as whole words.
FILLERS = """
thank you for the question|thank you for your question|thanks for the question|having read the extracts|regarding the requirement set out above|the supplier has read the following|requirement noted|in reply to|in response to|
our response|our answer|response to|answer to|with regard to|regarding|as requested|question|you ask|you asked|the requirement reads|the requirement says|we note the requirement|we note that|noted|re|q|a|please ask|
merci pour la question|merci de votre question|exigence notée|en réponse à|concernant|vielen dank für die frage|anforderung zur kenntnis genommen|zu|gracias por la pregunta|requisito anotado|en respuesta a
""".replace("\n", "").split("|")
_FILLS = re.compile(r"(?<!\S)(?:" + "|".join(sorted((re.escape(" ".join(words(f))) for f in FILLERS), key=len, reverse=True)) + r")(?!\S)")


class SuffixAutomaton:
    """All substrings of a word sequence; built online, linear in its length."""

    def __init__(self, sequence: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in sequence:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, sequence: list[str], least: int = 3) -> list[bool]:
        """Which words of sequence lie in a run of at least `least` words that the automaton's sequence has too."""
        out = [False] * len(sequence)
        state, size = 0, 0
        for i, w in enumerate(sequence):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            else:
                state, size = 0, 0
            if size >= least:
                out[i - size + 1 : i + 1] = [True] * size
        return out


@lru_cache(maxsize=64)
def _plain(requirement: str) -> str:
    return clean(requirement)[0]


def is_copied(answer: str, requirement: str | None) -> bool:
    """Nothing but the requirement's words: what no run shared with it covers is a filler, a few function words or
    words changed on the spot (one for one inside shared runs)."""
    if not requirement:
        return False
    plain = _plain(requirement)
    asked, said = words(plain), words(answer)
    if len(said) < 4 or not asked:
        return False
    said = " ".join(said)
    said = re.sub(r"^r \d+ ", "", said)
    said = _FILLS.sub(lambda m: m.group() if m.group() in asked else " ", said).split()
    if not said:
        return False
    known = set(asked)
    if 2 * sum(w in known for w in said) < len(said):
        return False  # fewer can't be covered than are known at all
    covered = SuffixAutomaton(asked).covered(said, 2 if len(asked) < 8 else 3)
    own = loose = 0
    for i, hit in enumerate(covered):
        if hit:
            continue
        near = any(covered[max(0, i - 2) : i]) and any(covered[i + 1 : i + 3]) or (i < 2 and any(covered[i + 1 : i + 4])) or (i >= len(covered) - 2 and any(covered[max(0, i - 3) : i]))
        if said[i] in known or near:
            loose += 1
        else:
            own += 1
    hits = sum(covered)
    return hits >= 0.5 * len(said) and own <= max(2, 0.12 * len(said)) and own + loose <= 0.45 * len(said) and hits >= min(4, len(asked))


# -- language and ends ----------------------------------------------------------------------------------------------


def other_language(answer: str, requirement: str | None) -> bool:
    """Most of the answer's words stand in sentences of another language than the requirement's own."""
    own = language(requirement and _plain(requirement)) or language(requirement, 0.5)
    if not own:
        return False
    whole = votes(answer)
    if not whole or whole.get(own, 0) >= max(whole.values()):
        return False
    other = same = 0
    for s in _SENTENCE.split(answer):
        if not s or not s.strip():
            continue
        n, found = len(words(s)), language(s, 0.5)
        if found == own:
            same += n
        elif found:
            other += n
    return other > same and other >= 3


_CLOSERS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_LIST_LINE = re.compile(r"^\s*(?:[-*•–+]|\d{1,3}[.)]|[a-zA-Z][.)]|\(\w{1,3}\))\s+")
_ENDS = re.compile(r"[.!?…。:;][\"'”’»)\]*_\s]*$|[)\]}\"”’»]\s*$")


def open_delimiters(text: str) -> list[str]:
    """The stack of delimiters still open at the end of text; straight quotes toggle, apostrophes don't count."""
    stack: list[str] = []
    for i, c in enumerate(text):
        if c in "([{“«":
            stack.append(c)
        elif c in _CLOSERS and stack and stack[-1] == _CLOSERS[c]:
            stack.pop()
        elif c == '"':
            stack.pop() if stack and stack[-1] == '"' else stack.append(c)
    return stack


def is_truncated(answer: str) -> bool:
    """Ends inside a word or sentence: no closing mark, and not a list item, a row, a short note or a sign-off."""
    text = _BLANK.sub(" ", answer.replace("\n", "\x00")).replace("\x00", "\n").rstrip()
    if not text:
        return False
    last = text.rsplit("\n", 1)[-1]
    if _LIST_LINE.match(last) or "|" in last:
        return False
    opened = open_delimiters(text)
    if re.search(r"\w(?:…|\.\.\.)$", text):
        return True
    if _ENDS.search(text):
        # a closing mark inside an open quotation or bracket ends nothing when the mark itself was cut, as in "(see 4."
        return bool(re.search(r"(?:[£€$]\s?\d[\d,]*|\b(?:below|above|at|to|of|by|reached)\s+\d{1,2})\.$", text)) or text[-1] in "," or (bool(opened) and opened[-1] in "([{" and not text.endswith(tuple(")]}")))
    if len(words(text)) <= 3 and "\n" not in text and not opened:
        return bool(re.search(r"\b(?:the|a|an|of|and|to|in|for|by|with|at|le|la|de|et|der|die|und|el|y)$|[,–-]$", text, re.I))
    return True


def defect(answer: str | None, sufficient: bool | None, note: str | None, requirement: str | None) -> str | None:
    """The draft's defect or None. A draft with sufficient false and a note is a proper decline: neither empty nor a
    refusal. Without a requirement text, copies and language can't be judged and give none."""
    declined = sufficient is False and note is not None and bool(_BLANK.sub("", note))
    if is_empty(answer):
        return None if declined else "empty"
    if is_refusal(answer):
        return None if declined else "refusal"
    if is_copied(answer, requirement):
        return "copied"
    if other_language(answer, requirement):
        return "other_language"
    return "truncated" if is_truncated(answer) else None


def broken_drafts(drafts: DataFrame, requirements: DataFrame) -> DataFrame:
    """(draft_id, defect) of every broken draft: empty, refusal, copied, other_language or truncated, at most one.

    drafts: draft_id, tender_id, requirement_id, answer, evidence_sufficient, note; requirements: tender_id, id, text.
    Repeated drafts and requirements count once, null draft ids are left out; a draft without a requirement (or with
    a null one) is judged by its answer alone. Both sides are joined by (tender_id, requirement id); every other
    column is dropped before the shuffle.
    """
    asked = (
        requirements.select("tender_id", F.col("id").alias("requirement_id"), F.col("text").alias("asked"))
        .where("tender_id is not null and requirement_id is not null")
        .groupBy("tender_id", "requirement_id").agg(F.max("asked").alias("asked"))
    )
    one = once(drafts.select("draft_id", "tender_id", "requirement_id", "answer", "evidence_sufficient", "note"), "draft_id")
    joined = one.join(asked, ["tender_id", "requirement_id"], "left").select("draft_id", "answer", "evidence_sufficient", "note", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [defect(*row) for row in zip(*(c.to_pylist() for c in b.columns[1:]))]
            keep = [i for i, k in enumerate(kinds) if k]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([kinds[i] for i in keep], pa.string())], ["draft_id", "defect"])

    return joined.mapInArrow(run, f"draft_id {drafts.schema['draft_id'].dataType.simpleString()}, defect string")
