"""Problem 4: text decoded with the wrong character encoding."""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that text is wrongly read in. Fixed values.
WRONG = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_2", "iso8859_15", "cp1253", "cp1254", "cp1257", "cp852", "cp866", "koi8_r")
#: Single-byte encodings that text in cp1252 is wrongly read in. Fixed values.
WRONG_SINGLE = ("mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1253", "cp852", "cp866", "koi8_r")

_PUNCT_OPEN, _PUNCT_CLOSE = "“‘„«‹", "”’»›"
_CURRENCY = "£€¥¢"
_JOINERS = "-'’"


def _byte_table(encoding: str) -> dict[str, int]:
    """Character -> byte from 0x80 on; bytes the encoding lacks stand for themselves (C1), as lenient readers do."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(encoding), b)
        except UnicodeDecodeError:
            pass
        out.setdefault(chr(b), b) if b < 0xA0 else None
    return out


_TABLES = {e: _byte_table(e) for e in WRONG}
_RUNS = {e: re.compile(f"[{re.escape(''.join(t))}]{{2,}}") for e, t in _TABLES.items()}


def _through_utf8(encoding: str) -> Callable[[str], str]:
    """Encode runs as the wrong encoding's bytes and decode them as UTF-8, each run as far as it is UTF-8."""
    table, runs = _TABLES[encoding], _RUNS[encoding]

    def again(m: re.Match) -> str:
        raw, out, i = bytes(table[c] for c in m.group()), [], 0
        while i < len(raw):
            size = 2 if 0xC2 <= raw[i] < 0xE0 else 3 if 0xE0 <= raw[i] < 0xF0 else 4 if 0xF0 <= raw[i] < 0xF5 else 0
            try:
                if not size or i + size > len(raw):
                    raise ValueError
                out.append(raw[i : i + size].decode("utf-8"))
                i += size
            except ValueError:
                out.append(m.group()[i])
                i += 1
        return "".join(out)

    return lambda text: runs.sub(again, text)


def _through_cp1252(encoding: str) -> Callable[[str], str]:
    """Encode single characters as the wrong encoding's bytes and decode them as cp1252."""
    table = {}
    for c, b in _TABLES[encoding].items():
        try:
            table[ord(c)] = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            pass
    return lambda text: text.translate(table)


_LOWERED = re.compile("[ãâåä](?=[^\x00-\x7fa-zßàáâäåæçèéêëìíîïñòóôöøùúûüý])")


def _raised(text: str) -> str:
    """Undo lower-casing of lead characters: a lower-case one before a sign can't be text. The lead of three bytes has
    no case to lose, so â before two signs stays."""
    return _LOWERED.sub(lambda m: m.group() if m.group() == "â" and not text[m.end() + 1 : m.end() + 2].isascii() else m.group().upper(), text)


def _unescaped(text: str) -> str:
    text = html.unescape(text)
    text = re.sub(r"\\u00([0-9a-fA-F]{2})|\\x([89a-fA-F][0-9a-fA-F])", lambda m: chr(int(m.group(1) or m.group(2), 16)), text)
    return re.sub(r"(?:[%=][89A-F][0-9A-F]){2,}", lambda m: bytes.fromhex(re.sub("[%=]", "", m.group())).decode("latin-1"), text)


OPERATIONS: dict[str, Callable[[str], str]] = {
    **{f"{e}>utf-8": _through_utf8(e) for e in WRONG},
    **{f"{e}>cp1252": _through_cp1252(e) for e in WRONG_SINGLE},
    "raise": _raised,
    "unescape": _unescaped,
}

#: Escapes of bytes above ASCII that only stand in text by accident.
_ESCAPED = re.compile(r"&(?:[AÂâa]tilde|[Aa]circ|#19[45]|#x[Cc][23]);(?=&|[^\x00-\x7f])|(?:%[CE][0-9A-F]%[89AB][0-9A-F])+|(?:=[CE][0-9A-F]=[89AB][0-9A-F])+|\\u00[c-e][0-9a-f]\\u00[89ab][0-9a-f]")

#: A character outside ASCII in a place where it can't be ordinary text needs a closer look; the rest is passed over.
_LOWER = "à-öø-ýÿßœšžłńśćęąźżőűčřěůďťňğışŵŷāēīōū"
_UPPER = "À-ÖØ-ÞŒŠŽŁŃŚĆĘŹŻŐŰČŘĚŮŸ"
#: It begins with the class of all such characters, so that ordinary stretches are skipped at the speed of a scan.
SUSPECT = re.compile(
    "[^\x00-\x7f](?:"
    + "|".join(
        (
            f"(?<=[^{_LOWER}{_UPPER}£€’‘“”–…°±§½µ¿—\xa0Ω])",
            f"(?<=[{_UPPER}])(?=[^a-zA-Z{_LOWER}{_UPPER}'’-])",
            f"(?<=[a-z{_LOWER}][{_UPPER}])",
            f"(?<=[{_LOWER}])(?=[0-9]|[^\x00-\x7f{_LOWER}’”])",
            f"(?<=[{_LOWER}])(?<![a-zA-Z{_LOWER}{_UPPER}'’-].)(?![a-z{_LOWER}])",
            r"(?<=[£€])(?!\d)|(?<=°)(?!C|F|\W|$)|(?<=°)(?<![\d ].)|(?<=±)(?!\d)|(?<=§)(?![\d\s])|(?<=½)(?=\w)|(?<=\w½)|(?<=\w¿)|(?<=¿)(?!\w)",
            r"(?<=µ)(?<!\s.)|(?<=Ω)(?!\W)|(?<=Ω)(?<!\d Ω)|(?<=\s—)(?=\w)|(?<=’)(?=[^\x00-\x7f]\w)|(?<=[“‘])(?=[^\x00-\x7f][^\x00-\x7f])|(?<=\xa0)(?=-)",
        )
    )
    + ")",
    re.DOTALL,
)


@lru_cache(maxsize=4096)
def _kind(c: str) -> str:
    name = unicodedata.name(c, "")
    category = unicodedata.category(c)
    if category[0] == "L":
        script = name.split(" ")[0]
        return script if script in ("LATIN", "GREEK", "CYRILLIC") else "OHM" if c == "Ω" else "OTHER"
    return category


def _char_cost(p: str, c: str, n: str, before: str, after: str) -> float:
    """How implausible c is between p and n (before, after: what is next to them)."""
    kind = _kind(c)
    if c == "�" or kind in ("Cc", "Cn", "Co", "Cs"):
        return 5.0
    letter_p, letter_n = p.isalpha(), n.isalpha()
    if kind in ("LATIN", "GREEK", "CYRILLIC") and c not in "ªºµ":
        script = kind
        same_p, same_n = letter_p and (p.isascii() and script == "LATIN" or _kind(p) == script), letter_n and (n.isascii() and script == "LATIN" or _kind(n) == script)
        if (letter_p and not same_p) or (letter_n and not same_n):
            return 3.0
        if script != "LATIN" and not (letter_p or letter_n):
            if n.isdigit():
                return 3.0
            return 0.3 if c in "Ωπµ" and p == " " and before.isdigit() else 2.0
        cost = 0.25 if script != "LATIN" or c in "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœšžł" or c in "âêôûëïüÿåäöçñéèŵŷğışőűąęćńśźżčěřůďťňăâîșțāēīōūģķļņ" else 1.5
        if c in "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØŒÙÚÛÜÝŠŽŁŃŚŻŹČŘŮĚŐŰŴŶ":
            cost = 0.25
        if c.isupper() and p.islower():
            return 3.0
        if 0x180 <= ord(c) < 0x250 and c not in "ơƠưƯșțȘȚǎǐǒǔ":
            return 2.5
        if n.isdigit():
            return 2.5
        if script == "LATIN" and letter_p and letter_n and not p.isascii() and not n.isascii():
            return cost + 1.25  # three in a row are rather one sign's bytes
        if not letter_p and not letter_n:
            if n in _JOINERS or p in _JOINERS:
                return cost
            return cost if c in "àáâèéìíòóùúåöæøÀÁÉÈÓÚÅÖŵŷçñÇÑ" and (c.islower() or not after.islower()) else 2.0
        if not letter_n and not n.isspace() and not n.isascii() and n not in _PUNCT_CLOSE + "–—…":
            return 2.5
        return cost
    word_p, word_n = p.isalnum(), n.isalnum()
    if c in _CURRENCY:
        return 0.0 if n.isdigit() and not letter_p else 0.1 if p.isdigit() or before.isdigit() and p.isspace() else 0.5 if n.isspace() and after.isdigit() else 2.0
    if c == "’" or c == "‘":
        return 0.1 if letter_p and (letter_n or n.isspace() or n in ".,;:!?)" or not n) or (c == "‘" or word_n) and not word_p else 1.0
    if c in _PUNCT_OPEN:
        return 0.1 if not word_p and (word_n or not n.isspace()) and not (c == "«" and n.islower() and p == " ") else 0.3 if c == "«" and n.isspace() else 2.0
    if c in _PUNCT_CLOSE:
        return 0.1 if not word_n and p and not p.isspace() else 0.3 if c == "»" and p.isspace() else 2.0
    if c in "–—…":
        return 1.5 if c == "—" and p == " " and letter_n else 0.1
    if c == "°":
        return 0.0 if p.isdigit() or p.isspace() and before.isdigit() and n in "CFcf .,;" else 0.5 if p.isspace() and n and n in "CF" else 2.0
    if c in "±×÷≤≥≈≠−":
        return 0.1 if not letter_p and not letter_n and not (p and not p.isascii()) else 2.5
    if c in "½¼¾§":
        return 0.1 if not word_p and (not word_n or c == "§" and n.isdigit()) and (c != "§" or n.isdigit() or n.isspace()) or p.isdigit() and c != "§" else 2.5
    if c in "²³¹":
        return 0.2 if p.isascii() and (p.isdigit() or p in "mM") else 2.5
    if c in "ªº":
        return 0.2 if p.isdigit() or p in "nN" and not letter_n else 2.5
    if c in "¿¡":
        return 0.1 if (letter_n or n in _PUNCT_OPEN) and not word_p else 2.5
    if c == "µ":
        return 0.1 if (p == " " or p.isdigit()) and n in "mslgLAVF" else 2.5
    if c == "Ω":
        return 0.1 if before.isdigit() or p.isdigit() else 2.0
    if c == "\xa0":
        return 1.0 if (letter_p and not p.isascii()) or n == "-" else 0.1
    if c in "®™©":
        return 0.3 if p.isascii() and (letter_p or p in " )") and not letter_n else 2.5
    if c in "•▪●✓✔☐☑→←":
        return 0.1 if not word_p and not word_n else 2.0
    if kind in ("Zs", "Cf", "Pd"):
        return 0.2
    if kind in ("Mn", "Mc"):
        return 1.5 if letter_p else 2.5
    if unicodedata.category(c) == "Lm":
        return 2.5
    if kind == "OTHER":
        return 3.0 if letter_p and p.isascii() or letter_n and n.isascii() else 0.5
    if 0x2500 <= ord(c) < 0x25A0:
        return 3.0
    return 2.5 if letter_p or letter_n or not (p.isascii() and n.isascii()) else 1.2


_BEYOND = re.compile("[^\x00-\x7f]")


def cost(text: str) -> float:
    """The sum of all characters' implausibility; 0 for ASCII."""
    total = 2.5 * len(_ESCAPED.findall(text))
    for m in _BEYOND.finditer(text):
        i = m.start()
        total += _char_cost(text[i - 1 : i], m.group(), text[i + 1 : i + 2], text[i - 2 : i - 1] if i > 1 else "", text[i + 2 : i + 3])
    return total


#: UTF-8 proves itself when it is decoded; a single-byte encoding always decodes, so a step through one has a price.
BLIND = 1.0
#: A passage counts as garbled if its cost falls by this much.
LEAST_GAIN = 1.0
#: States opened for a passage before it is cut in two, operations in a row, and how much worse than the passage a state on
#: the way may be (a factor and a sum).
STATES, STEPS, WORSE = 40, 4, (1.5, 4.0)


def restore(passage: str, most: int = STATES) -> tuple[str, float, float, tuple[str, ...], bool]:
    """(cheapest reachable text, cost before, cost after, operations, whether states were left): best-first over OPERATIONS.

    The heap is ordered by cost plus a little for each step, so the plainest text reached by the fewest operations
    comes first; visited states are kept by hash. It ends at a text in which nothing is implausible, when the heap is
    empty or when `most` states were opened.
    """
    before = cost(passage)
    best = (before, passage, ())
    heap = [(before, 0, passage, (), 0.0)] if before >= LEAST_GAIN else []
    seen, opened, serial = {hash(passage)}, 0, 0
    while heap and opened < most:
        rank, _, state, path, steps = heapq.heappop(heap)
        opened += 1
        if len(path) >= STEPS:
            continue
        for name, operation in OPERATIONS.items():
            blind = name.endswith(">cp1252")
            if blind and any(x.endswith(">cp1252") for x in path):
                continue
            after = operation(state)
            if after == state or hash(after) in seen:
                continue
            seen.add(hash(after))
            paid = steps + (BLIND if blind else 0.05)
            price = cost(after) + paid
            if price < best[0]:
                best = (price, after, (*path, name))
                if best[0] - paid <= 0.3 * len(_BEYOND.findall(after)):
                    return after, before, price, best[2], False
            if price < WORSE[0] * before + WORSE[1]:  # a step may look worse before the next puts it right
                serial += 1
                # raised leads look as bad as lowered ones until they are decoded: such a state keeps its parent's place
                place = rank if name == "raise" else price + 0.5 * sum(x != "raise" for x in path)
                heapq.heappush(heap, (place, serial, after, (*path, name), paid))
    return best[1], before, best[0], best[2], bool(heap)


def restore_in_parts(passage: str, most: int = STATES) -> tuple[str, float, float, tuple[str, ...], bool]:
    """restore(), and where it ends with states left, each half of the passage by itself, cut at a blank between its
    doubtful characters: faults of several kinds come apart, and the search grows with the passage and no faster."""
    found = restore(passage, most)
    if not found[4]:
        return found
    spots = [m.start() for m in SUSPECT.finditer(passage)]
    middle = (spots[len(spots) // 2 - 1] + spots[len(spots) // 2]) // 2 if len(spots) > 1 else 0
    blanks = [m.end() for m in re.finditer(r"\s+", passage) if spots and spots[0] < m.end() <= spots[-1]]
    if not blanks:
        return found
    cut = min(blanks, key=lambda at: abs(at - middle))
    halves = [restore_in_parts(part, most) for part in (passage[:cut], passage[cut:])]
    apart = ("".join(h[0] for h in halves), found[1], sum(h[2] for h in halves), tuple(dict.fromkeys(o for h in halves for o in h[3])), any(h[4] for h in halves))
    return apart if apart[2] < found[2] else (*found[:4], apart[4])


_PASSAGE = re.compile(r"[^\n.!?]*(?:[.!?](?!\s)[^\n.!?]*)*(?:[.!?]+\s*|\n+|$)")
#: Traces that can't be undone: the replacement character, C1 controls, lead characters before half a sequence.
LOST = re.compile("�|[\x80-\x84\x86-\x9f]|â€|[ÃÂ][\xa0-\xbf]")


def examine(text: str) -> tuple[bool, str, bool, str]:
    """(garbled, restored text, whether it is complete, operations used) of one text: complete if no character was lost for
    good and no search ended with states left."""
    if not SUSPECT.search(text) and not _ESCAPED.search(text):
        return False, text, True, ""
    out, garbled, clean, used = [], False, True, {}
    for m in _PASSAGE.finditer(text):
        passage = m.group()
        if passage and (SUSPECT.search(passage) or _ESCAPED.search(passage)):
            fixed, before, after, path, left = restore_in_parts(passage)
            clean = clean and not left
            if before - after >= LEAST_GAIN:
                garbled, passage = True, fixed
                used.update(dict.fromkeys(path))
            if LOST.search(passage):
                garbled, clean = True, False
        out.append(passage)
    return garbled, "".join(out), clean, " ".join(used)


def garbled_texts(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, restored, complete, operations) of every row whose text holds a wrongly decoded passage.

    complete is false where characters were lost for good or a search ended before all its states were opened; the rest of such a text is restored all the same. Null
    texts and texts of ASCII only give no row; null keys are kept; repeated rows (equal keys) come once; other columns
    are ignored. The result doesn't depend on other rows, so nothing is shuffled before the few rows found.
    """
    named = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                garbled, fixed, clean, used = examine(t)
                if garbled:
                    rows.append(i)
                    found.append((fixed, clean, used))
            took = b.select(list(range(len(keys)))).take(pa.array(rows, pa.int64()))
            cols = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [*took.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string())],
                [*keys, "restored", "complete", "operations"],
            )

    beyond = df.where(F.col(text).rlike(r"[^\x00-\x7F]|&[#A-Za-z]|%[CE]|=[CE]|\\u00"))
    return beyond.select(*keys, text).mapInArrow(run, ", ".join([*named, "restored string, complete boolean, operations string"])).dropDuplicates(list(keys))
