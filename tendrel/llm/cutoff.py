"""Problem 9: text cut off by field limits or in transfer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tendrel.llm.common import _powers, _BASE, _INVERSE, distinct_pairs, mix, passes, shingle_hashes, sieve, string_bytes, whole, word_hashes
from tendrel.llm.language import FUNCTION_WORDS
from tendrel.llm.neardup import CACHED, _chains, _fold, _slots
from tendrel.session import materialise

#: Near-copies: five words, and 0.8 of the shorter text's runs held by the other, found with BANDS chains of ROWS segments.
#: The beginnings of texts are sketched at lengths that grow by GROWTH from SHORTEST runs on, so a copy that was cut anywhere
#: has a beginning of its original within a factor of the root of GROWTH: alike at 0.816 or more if nothing else was changed,
#: and missed with probability (1 - 0.816 ** ROWS) ** BANDS, about 1e-5; at 0.65 it is 2 in a hundred.
WORDS, LIKENESS, BANDS, ROWS = 5, 0.8, 20, 4
SHORTEST, GROWTH = 16, 1.5

#: A closing with a smaller share of ends among its occurrences is not where texts end.
TERMINAL_SHARE = 0.12
#: The same where the last line is a list item or row, or stands by itself: these need no full stop.
ITEM_SHARE, LONE_SHARE = 0.008, 0.01
#: The same for a sentence with a single blank behind its last word, where another word may have been cut away.
BLANK_SHARE = 0.75

# -- how a text ends -------------------------------------------------------------------------------------------------

_SPACE = " \t\r\n\x0b\x0c\x85\xa0​‌‍⁠﻿  "
#: What is put in the place of a cut-off rest.
_MARK = re.compile(
    r"(?:\[\s*(?:\.{2,}|…|truncated|cut(?: off)?|clipped|more|continued|snip|gekürzt|tronqué|truncado|recortado)\s*\]|"
    r"\(\s*(?:\.{3}|…|truncated|cut off|continued|to be continued|gekürzt|tronqué|truncado)\s*\)|<\s*(?:truncated|cut|snip)\s*>|(?<!\.)\.{3}|…|\b(?:read|show) more|>>+)$",
    re.I,
)
#: Phrases after which dots stand for themselves.
_OPEN_ENDED = re.compile(r"(?:\band so (?:on|forth)|\betc\.?|\busw\.?|\bund so weiter|\bet ainsi de suite|\by así sucesivamente|\betcétera)[ ,]*$", re.I)
_CLOSED = re.compile(r"(?:[.!?。]|[)\]}»”\"’']|_{3,}|\.{4,}|-{3,}|={3,}|\*{3,})[*_`~\s]*$")
CLOSED, CUT, OPEN, BLANK = "closed", "cut", "open", "blank"


def ending(text: str | None) -> tuple[str, int]:
    """(kind of ending, characters before a mark that stands for the rest)."""
    if text is None:
        return BLANK, 0
    t = text.rstrip(_SPACE)
    if not t:
        return BLANK, 0
    last = t[-80:]
    if m := _MARK.search(last):
        base = t[: len(t) - len(m.group())].rstrip(_SPACE)
        last = base[-80:]
        if not base or _OPEN_ENDED.search(last):
            return CLOSED, len(t)
        plain = m.group() in ("...", "…")
        return (CLOSED if plain and not re.search(r"[\w,;£€$%-]", base[-1]) else CUT), len(base)
    if t[-1] == "�" or t[-1] in ",;([{“«&/£€$+=-–—" and not _CLOSED.search(last):
        return CUT, len(t)
    if _CLOSED.search(last):
        return CLOSED, len(t)
    return OPEN, len(t)


#: Closed by a bracket, a quotation mark or a stop behind a number or a short word: a copy may still show that more follows.
_DOUBTFUL = re.compile(r"(?:[^.!?…\s][)\]}»”\"’']+|(?:\b\w{1,3}|\d)\.)$")


def doubtful(text: str) -> bool:
    return bool(_DOUBTFUL.search(text.rstrip(_SPACE)[-20:]))


_ITEM = re.compile(r"^\s*(?:[-*•–+]|\d{1,3}[.)]\s(?=\S{1,30}(?:\s\S+){0,7}$)|[a-z][.)])\s+\S")
ITEM, ROW, LONE, SIGNED, SENTENCE = "item", "row", "lone", "signed", "sentence"
#: A short line of words only, as stands above a name at the end of a letter.
_SIGN_OFF = re.compile(r"^\s*[^\W\d_]+(?: [^\W\d_]+){0,5},?\s*$")
_FUNCTION = frozenset(" ".join(FUNCTION_WORDS.values()).split())


def last_line(text: str) -> str:
    """The form of the last line: list item, row of cells, signed (a name under a closing phrase), lone (a heading or
    other short line that stands by itself) or sentence."""
    lines = [x for x in text.rstrip(_SPACE).splitlines() if x.strip(_SPACE)]
    line = lines[-1].strip(_SPACE) if lines else ""
    if "|" in line:
        return ROW
    if _ITEM.match(line):
        return ITEM
    words = line.split()
    n = len(words)
    before = lines[-2].rstrip(_SPACE) if len(lines) > 1 else ""
    if n <= 4 and _SIGN_OFF.match(before) and line[0].isupper() and words[-1].lower() not in _FUNCTION:
        return SIGNED
    if line.startswith("#") or (n <= 7 and len(lines) > 1 and not re.match(r"\(?(?:[A-Z]?\d+[.:)]|\d+\.\d)", line) and (n <= 4 or line.istitle() or _CLOSED.search(before) or len(before.split()) <= 4)):
        return LONE
    return SENTENCE


# -- closing words -----------------------------------------------------------------------------------------------------

_LETTER = np.zeros(256, dtype=np.uint64)
for _c in range(0x80, 0x100):
    _LETTER[_c] = _c
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ$%#":
    _LETTER[_c] = _c
for _c in b"0123456789":
    _LETTER[_c] = 48
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_UPPER[0xC3:0xD0] = True
_ENDS = np.zeros(256, bool)
for _c in b".!?\n\r":
    _ENDS[_c] = True
_NAME = np.uint64(0x5851F42D4C957F2D)


def closings(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hashes of the word with the two before, with the one before, and alone, whether a sentence or line ends
    after it) of every word of all values. Digits count as one digit, names inside a sentence as one name."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), z, z, z, np.zeros(0, bool)
    v = _LETTER[raw].copy()
    digit = _IS_DIGIT[raw]
    joint = np.zeros(n, bool)
    joint[1:-1] = ((raw[1:-1] == 44) | (raw[1:-1] == 46)) & digit[:-2] & digit[2:]
    v[joint] = 44
    inside = v != 0
    edge = np.zeros(n + 1, bool)
    edge[at[:-1][at[:-1] < n]] = True
    edge[n] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(v * _powers(_BASE, n), out=prefix[1:])
    word = mix((prefix[end] - prefix[start]) * _powers(_INVERSE, n)[start] + (end - start).astype(np.uint64))
    owner = np.searchsorted(at, start, side="right") - 1
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
    # what stands between this word's end and the next word: a sentence or line end closes it
    padded = np.concatenate((raw, np.full(2, 10, np.uint8)))
    next_start = np.concatenate((start[1:], [n]))
    last = np.concatenate((first[1:], [True]))
    closes = last | _ENDS[padded[end]] | (next_start - end >= 2) & (_ENDS[padded[np.minimum(end + 1, n)]])
    name = _IS_UPPER[raw[start]] & ~first & ~np.concatenate(([True], closes[:-1])) & ~_IS_DIGIT[raw[np.maximum(0, start - 2)]]
    word[name] = _NAME
    previous = np.concatenate((np.zeros(1, np.uint64), word[:-1]))
    previous[first | np.concatenate(([True], closes[:-1]))] = np.uint64(1)
    pair = mix(previous * np.uint64(0x9E3779B97F4A7C15) + word)
    before_pair = np.concatenate((np.zeros(1, np.uint64), pair[:-1]))
    before_pair[previous == 1] = np.uint64(1)
    return owner, mix(before_pair * np.uint64(0xC2B2AE3D27D4EB4F) + word), pair, word, closes


def _closing_stats(asked):
    """(text) -> (k, ends, total): occurrences and ends of each closing that is asked for, added up within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = whole(b.column(0))
            # an open end in a sentence or list may be a cut: its last word is no occurrence, or copies of a cut text would
            # vouch for each other; other last words are occurrences and ends
            bare, tails = _tails(pc.fill_null(col, ""))
            may_be_cut = np.array([(e := ending(t)[0]) == CUT or e == OPEN and _form(bare, i, t) in (SENTENCE, ITEM) for i, t in enumerate(tails.to_pylist())], bool)
            keys, ends = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for i in range(0, len(col), CACHED):
                owner, *levels, closes = closings(*string_bytes(col[i : i + CACHED]))
                last = np.concatenate((owner[1:] != owner[:-1], [True])) if len(owner) else np.zeros(0, bool)
                counts = ~(last & may_be_cut[i : i + CACHED][owner])
                for key in levels:
                    ok = counts & passes(asked.value, key)
                    keys.append(key[ok])
                    ends.append(closes[ok])
            value, back, total = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            ended = np.bincount(back, weights=np.concatenate(ends), minlength=len(value)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ended), pa.array(total.astype(np.int64))], ["k", "ends", "total"])

    return run


#: Characters at the end of a text, blanks behind it left out, that its kind of ending and closing words are read from.
TAIL = 1000


def _tails(col: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(texts without the blanks at their ends, the last TAIL characters of these, and the blank if it was just one)."""
    bare = pc.utf8_rtrim(col, characters=_SPACE)
    single = pc.and_(pc.equal(pc.utf8_length(col), pc.add(pc.utf8_length(bare), 1)), pc.ends_with(col, " "))
    blank = pc.if_else(single, pa.scalar(" ", col.type), pa.scalar("", col.type))
    return bare, pc.binary_join_element_wise(pc.utf8_slice_codeunits(bare, -TAIL), blank, pa.scalar("", col.type))


def _form(bare: pa.Array, i: int, tail: str) -> str:
    """The form of text i's last line; the whole text is read where its last two lines may begin before the tail."""
    if len(tail) >= TAIL and sum(bool(x.strip(_SPACE)) for x in tail.splitlines()) < 3:
        tail = bare[i].as_py()
    return last_line(tail)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, source, same, text) -> (id, source, same, kind, line, blank, length, triple, pair, word, keys); keys are those
    of texts that a copy can decide."""
    for b in batches:
        col = whole(b.column(3))
        # how a text ends shows in its last characters; the rest of it goes into the sketch and the statistics
        bare, tails = _tails(col)
        kinds, lengths, forms, blanks, sought = [], [], [], [], []
        for i, (t, n) in enumerate(zip(tails.to_pylist(), pc.utf8_length(bare).to_pylist())):
            k, end = ending(t)
            kinds.append(k)
            lengths.append(max(0, n - TAIL) + end)
            forms.append(_form(bare, i, t) if k == OPEN else None)
            blanks.append(k == OPEN and t.endswith(" "))
            sought.append(k == OPEN or k == CLOSED and doubtful(t))
        opened = np.flatnonzero(np.array(kinds) == OPEN) if kinds else np.zeros(0, np.int64)
        owner, triple, pair, word, _ = closings(*string_bytes(tails.take(pa.array(opened))))
        last = np.flatnonzero(np.concatenate((owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(0, int)
        ends_in = np.zeros((3, len(col)), np.uint64)
        ends_in[:, opened[owner[last]]] = triple[last], pair[last], word[last]
        few = np.flatnonzero(np.array(sought, bool)) if sought else np.zeros(0, np.int64)
        h, own = _runs(col.take(pa.array(few)))
        who, slots = _slots(h, own, len(few), BANDS * ROWS, 9)
        chain = _chains(slots, ROWS, 9 << 32)
        counts = np.zeros(len(col), np.int64)
        counts[few[who]] = BANDS
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0), b.column(1), b.column(2), pa.array(kinds, pa.string()), pa.array(forms, pa.string()), pa.array(blanks, pa.bool_()), pa.array(lengths, pa.int32()),
                *(pa.array(x.view(np.int64)) for x in ends_in),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(chain.ravel().view(np.int64))),
            ],
            ["id", "source", "same", "kind", "line", "blank", "length", "triple", "pair", "word", "keys"],
        )


def _runs(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word runs of each text in order, repeats kept, and the text each is in."""
    return shingle_hashes(*word_hashes(*string_bytes(_fold(col))), WORDS)


def beginnings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the chains of each text's beginnings, the whole text among them."""
    h, own = _runs(col)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(h)) - np.searchsorted(own, own)
    sizes = [SHORTEST]
    while sizes[-1] <= at.max():
        sizes.append(int(sizes[-1] * GROWTH))
    stretch = np.searchsorted(sizes, at, side="right")
    # segments of each stretch by themselves, then the least of all stretches up to it
    who, slots = _slots(h, own * len(sizes) + stretch, len(col) * len(sizes), BANDS * ROWS, 9)
    text, place = who // len(sizes), who % len(sizes)
    for n in range(1, len(sizes)):
        here = np.flatnonzero(place == n)
        slots[here] = np.minimum(slots[here], slots[here - 1])
    keys = _chains(slots, ROWS, 9 << 32)
    return np.repeat(text, BANDS), keys.ravel()


def _sought_beginnings(sought):
    """(same, text) -> (same, k) of the chains of beginnings that an undecided text has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, CACHED):
                part = b[i : i + CACHED]
                text, key = beginnings(whole(part.column(1)))
                ok = passes(sought.value, key)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text[ok])), pa.array(key[ok].view(np.int64))], ["same", "k"])

    return run


def _only(needed):
    """(same, text, hash of same) -> (same, text) of the texts that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passes(needed.value, np.asarray(b.column(2)).view(np.uint64)))).select(["same", "text"])

    return run


# -- alignment -----------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+")


@lru_cache(maxsize=4096)
def _end_of(text: str) -> tuple[re.Pattern, str, str] | None:
    """(pattern of the last eight words, the last of which may be cut; that word; what stands behind it) of a text."""
    t = text.rstrip(_SPACE)
    if m := _MARK.search(t[-80:]):
        t = t[: len(t) - len(m.group())].rstrip(_SPACE)
    # eight words stand in the last hundred characters or so; where they don't, more is read
    reach = 100
    while len(words := list(_TOKEN.finditer(t, max(0, len(t) - reach)))) < 9 and reach < len(t):
        reach *= 2
    if len(words) < 8:
        return None
    tail, last = [w.group().lower() for w in words[-8:-1]], words[-1].group().lower()
    pattern = re.compile(r"(?<![^\W_])" + r"[\W_]+".join(map(re.escape, tail)) + r"[\W_]+(" + re.escape(last) + r"[^\W_]*)", re.I)
    return pattern, last, t[words[-1].end() :].rstrip(_SPACE)


def continues(text: str, other: str) -> bool | None:
    """Whether other goes on inside a sentence where text ends (True), ends a sentence there (False), or neither can be
    told (None). The texts must be near-copies; the last words of text are looked up in other, the latest place first."""
    if (end := _end_of(text)) is None:
        return None
    pattern, last, own_rest = end
    match = None
    for match in pattern.finditer(other):
        pass
    if match is None:
        return None
    if match.end() - match.start(1) > len(last):
        return True
    rest = other[match.end() :]
    if own_rest and rest.startswith(own_rest):
        rest = rest[len(own_rest) :]
    gap = re.match(r"[^\w]*", rest).group()
    if not rest.strip(_SPACE):
        return None
    return not (re.match(r"[ \t]*[.!?:;…]|[\"”’)\]]*[.!?]|[ \t]*\r?\n", gap) or len(gap) == len(rest))


def held(text: str, other: str) -> float:
    """Share of the shorter text's distinct runs that the other has."""
    h, own = distinct_pairs(*_runs(pa.array([text, other], pa.string())))
    x, y = h[own == 0], h[own == 1]
    return len(np.intersect1d(x, y, assume_unique=True)) / max(1, min(len(x), len(y)))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, text, other) -> (same, goes_on) of verified near-copies: does the other go on where the text ends?"""
    for b in batches:
        names = b.schema.names
        out = []
        for i, t, o in zip(*(b.column(names.index(c)).to_pylist() for c in ("same", "text", "other"))):
            c = continues(t, o)
            if c is not None and held(t, o) >= LIKENESS:
                out.append((i, c))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.bool_())], ["same", "goes_on"])


# -- the operator ----------------------------------------------------------------------------------------------------------


def cut_off(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, kind, line, aligned, share, at_limit, truncated, decided_by) of every document with a non-blank text.

    kind: how the text ends by its last signs (closed, cut, open); a mark for a missing rest, half a character or an open
    bracket are cuts. line: the form of an open text's last line. decided_by names what decided, in this order: signs (a
    cut); copy (near-copies by five-word runs, 0.8 of the shorter one's held, whose alignment goes on there, aligned true,
    or closes there, false); end (closed, and no copy goes on); words (how often the closing three, two or one words end a
    sentence or line in the whole collection: share, against TERMINAL_SHARE); limit (the words may end a text, but many
    open texts of the source end at the same length); none (words that may end a text, at no limit).

    Null and blank texts and null keys give no row; repeated keys count once; a null source is a source of its own;
    other columns are ignored. Equal texts are judged once and share the result: a text cut by one source's limit is cut in every copy.

    Statistics are added up in each batch before their shuffle; only texts that end open or doubtfully look for copies,
    and of the others' chains only those that some such text has (by a filter of bounded size) are shuffled; equal texts
    are one there, so a hot text makes no pairs.
    """
    rows = df.select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).where("id is not null and text is not null").withColumn("same", F.unhex(F.sha2("text", 256)))
    docs = materialise(rows.select("id", "source", "same", "text").mapInArrow(_profile, f"id {df.schema[key].dataType.simpleString()}, source {df.schema[source].dataType.simpleString()}, same binary, kind string, line string, blank boolean, length int, triple bigint, pair bigint, word bigint, keys array<bigint>").where(F.col("kind") != BLANK).dropDuplicates(["id"]))
    reps = docs.where((F.col("kind") == OPEN) | (F.size("keys") > 0)).groupBy("same").agg(*(F.first(c).alias(c) for c in ("kind", "line", "blank", "triple", "pair", "word")), F.first("keys").alias("keys"))
    reps = materialise(reps)
    unsure = reps.where(F.col("kind") == OPEN)
    open_texts, keys = reps.agg(F.count_if(F.col("kind") == OPEN), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()

    levels = F.array(*(F.struct(F.lit(n).alias("n"), F.col(c).alias("k")) for n, c in ((3, "triple"), (2, "pair"), (1, "word"))))
    wanted = unsure.select("same", F.explode(levels).alias("w")).select("same", "w.n", "w.k")
    asked = sieve(wanted.select(F.col("k").alias("u")), 3 * open_texts)
    stats = rows.select("text").mapInArrow(_closing_stats(asked), "k bigint, ends bigint, total bigint").groupBy("k").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total"))
    scored = (
        stats.join(wanted, "k")
        .groupBy("same").agg(*(F.max(F.when(F.col("n") == n, F.col(c))).alias(f"{c}{n}") for n in (1, 2, 3) for c in ("ends", "total")))
    )
    # the text's own last word, where it was counted, says nothing about itself: one occurrence and one end less; rare
    # triples give way to pairs, rare pairs to the word
    own = F.col("line").isin(LONE, ROW, SIGNED).cast("int")
    enough = {3: 3, 2: 3, 1: 1}
    share = F.lit(None).cast("double")
    for n in (1, 2, 3):
        share = F.when(F.col(f"total{n}") - own > enough[n], (F.col(f"ends{n}") - own) / (F.col(f"total{n}") - own)).otherwise(share)
    scored = unsure.select("same", "line").join(scored, "same", "left")
    scored = scored.withColumn("share", share)
    scored = scored.select("same", "share", F.coalesce(F.col("total1") - own <= enough[1], F.lit(True)).alias("unknown"))

    left = reps.select("same", F.explode("keys").alias("k"))
    right = rows.select("same", "text").mapInArrow(_sought_beginnings(sieve(left.select(F.col("k").alias("u")), keys)), "same binary, k bigint").distinct()
    pairs = materialise(left.join(right.withColumnRenamed("same", "other_same"), "k").where("same <> other_same").select("same", "other_same").distinct())
    needed = sieve(pairs.select(F.explode(F.array("same", "other_same")).alias("same")).select(F.xxhash64("same").alias("u")), 2 * pairs.count())
    texts = rows.select("same", "text", F.xxhash64("same").alias("u")).mapInArrow(_only(needed), "same binary, text string").dropDuplicates(["same"])
    aligned = (
        pairs.join(texts, "same").join(texts.toDF("other_same", "other"), "other_same").select("same", "text", "other").mapInArrow(_align, "same binary, goes_on boolean")
        .groupBy("same").agg(F.max("goes_on").alias("aligned"))
    )
    judged = reps.select("same").join(aligned, "same", "left").join(scored, "same", "left")

    per_source = docs.select("id", "source", "same", "kind", "line", "blank", "length")
    lengths = per_source.where(F.col("kind").isin(OPEN, CUT)).groupBy("source", "length").count()
    around = Window.partitionBy("source").orderBy("length").rangeBetween(-5, 0)
    near = Window.partitionBy("source").orderBy("length").rangeBetween(-200, 200)
    # a pile: many open ends within five characters, far denser than their surroundings
    piles = (
        lengths.withColumn("pile", F.sum("count").over(around)).withColumn("about", F.sum("count").over(near))
        .where("pile >= 5 and pile * 2 > about and count >= 2 and count * 10 >= pile").select("source", F.explode(F.sequence(F.col("length") - 5, F.col("length"))).alias("length")).distinct()
    )
    limited = (
        per_source.join(piles.toDF("pile_source", "pile_length"), F.col("source").eqNullSafe(F.col("pile_source")) & (F.col("length") == F.col("pile_length")), "left_semi")
        .select("same", F.lit(True).alias("at_limit")).distinct()
    )
    result = (
        per_source.join(judged, "same", "left").join(limited, "same", "left")
        .select("id", "source", "kind", "line", "blank", "aligned", F.round("share", 6).alias("share"), F.coalesce("at_limit", F.lit(False)).alias("at_limit"), "unknown")
    )
    share, line = F.coalesce("share", F.lit(0.0)), F.col("line")
    by_words = F.coalesce(
        F.when(line == SIGNED, False).when(line == LONE, ~F.col("unknown") & (share < LONE_SHARE))
        .when(line.isin(ITEM, ROW), F.when(F.col("unknown"), True).otherwise(share < ITEM_SHARE))
        .otherwise(F.col("unknown") | (share < F.when(F.col("blank"), BLANK_SHARE).otherwise(TERMINAL_SHARE))),
        F.lit(True),
    )
    closed, copied = F.col("kind") == CLOSED, F.col("aligned")
    decided = (
        F.when(F.col("kind") == CUT, "signs").when(copied | ~closed & copied.isNotNull(), "copy").when(closed, "end")
        .when(by_words, "words").when(F.col("at_limit"), "limit").otherwise("none")
    )
    truncated = F.col("decided_by").isin("signs", "words", "limit") | (F.col("decided_by") == "copy") & F.col("aligned")
    return result.withColumn("decided_by", decided).withColumn("truncated", truncated).drop("unknown", "blank").withColumnRenamed("id", key)


def source_rates(cut: DataFrame) -> DataFrame:
    """(source, documents, truncated, share) of the documents that cut_off judged."""
    return cut.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("truncated").cast("bigint")).alias("truncated")).withColumn("share", F.round(F.col("truncated") / F.col("documents"), 6))
