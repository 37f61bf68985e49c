"""Votes of function words for the language of a text."""

from __future__ import annotations

import re

#: Function words by language; a word several languages have votes for each with its share.
FUNCTION_WORDS = {
    "en": "a an these those than into per should may can you your do does did how many most some the of and to in is are for by with that at from on be as or an this it will shall must our we was has have been which who not their its any each within before when under how what",
    "fr": "cet tout toute tous doit être aux ou où leur ces entre comme plus le la les de des du et à en un une est sont pour par avec dans que qui sur au aux ce cette ses son sa nous vous il elle leur ne pas se plus fin depuis chaque comment leurs après l d s qu",
    "de": "muss soll durch über unter zwischen kann können alle der die das und in den von zu mit für im ist sind des dem auf nicht ein eine einer einen werden wird sich auch an als bei nach vor aus am wie sie wir ohne liegt seit statt dort einschließlich",
    "es": "a cualquier deberá debe este esta estos estas entre sobre también cuando qué quién otro otra todo todos muy el la los las de del y en un una es son por para con que se al su sus como más lo no o cada hasta según desde menos casi toda hace antes cómo días días sin",
    "it": "a il lo la gli le di del della dei degli e è in un una per con che si al alla da dal dai non sono sono i ogni entro senza viene vengono dopo dura ed ogni restano nel",
    "nl": "de het een en van in is te op met voor dat die niet zijn aan er door bij naar ook om tot uit wordt worden binnen na ieder jaar daar sinds zonder",
    "pl": "i w na z do nie się jest są przez o od dla po że jak oraz co bez te ten ta są każda przed oraz przy nad pod jest był być który która które tym tego tych tylko także ich jego",
    "pt": "o os as a de do da dos das e em um uma é são para por com que não se ao no na nos nas foi mais como cada até sem",
    "sv": "och att det som en ett av är för på med den till inte om har de vid från efter inom varje under utan",
    "da": "og at det som en et af er for på med den til ikke om har de ved fra efter inden hver under uden i",
}

_VOTES: dict[str, dict[str, float]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _VOTES.setdefault(_w, {})[_lang] = 0.0
for _w, _v in _VOTES.items():
    for _lang in _v:
        _v[_lang] = 1 / len(_v)

#: Letters that speak for a language where function words are few. Fixed values.
_LETTERS = {"ł": "pl", "ą": "pl", "ę": "pl", "ż": "pl", "ś": "pl", "ć": "pl", "ß": "de", "¿": "es", "¡": "es", "œ": "fr"}
_WORD = re.compile(r"[^\W\d_]+")


def _begins(text: str, start: int) -> bool:
    """Whether a sentence, line or the like begins at start."""
    at = start - 1
    while at >= 0 and text[at].isspace():
        at -= 1
    return at < 0 or text[at] in ".!?:|\"“¿"


def votes(text: str) -> dict[str, float]:
    """Votes by language; words with a capital (names) only vote at the start of the text or a sentence."""
    out: dict[str, float] = {}
    for m in _WORD.finditer(text):
        found = m.group()
        word = found.lower()
        own = _VOTES.get(word)
        if own is None and word.isascii():
            continue
        if found[0].isupper() and m.start() and not _begins(text, m.start()) and not (len(found) > 1 and found.isupper()):
            continue
        for lang, vote in (own or {}).items():
            out[lang] = out.get(lang, 0.0) + vote
        if not word.isascii() and not found[0].isupper():
            for c in set(word) & _LETTERS.keys():
                out[_LETTERS[c]] = out.get(_LETTERS[c], 0.0) + 0.5
    return out


def language(text: str | None, least: float = 1.0) -> str | None:
    """The language with most votes, if it has `least` votes and a lead; else None."""
    if not text:
        return None
    ranked = sorted(votes(text).items(), key=lambda x: (-x[1], x[0]))
    if not ranked or ranked[0][1] < least or (len(ranked) > 1 and ranked[1][1] > 0.8 * ranked[0][1]):
        return None
    return ranked[0][0]
