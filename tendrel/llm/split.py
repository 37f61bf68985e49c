"""Problem 5: cutting oversized items at natural boundaries."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendrel.llm.common import once

#: Strength of the boundary after an atomic segment; the weakest are merged first.
WORD, SENTENCE, LINE, PARAGRAPH = 0, 1, 2, 3

_SENTENCE = re.compile(r"(?<=[.!?…;])[\"'”’)\]]*[ \t]+(?=\S)")
_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_WORD = re.compile(r"\s+")


def _atoms(text: str, room: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at end) of segments of at most room characters that cover text."""
    cuts: dict[int, int] = {}
    for m in _LINE.finditer(text):
        cuts[m.end()] = LINE
    for at in list(cuts):
        # white space only up to the next line break: the boundary is a paragraph's
        nxt = _LINE.search(text, at)
        if nxt and not text[at : nxt.start()].strip():
            cuts[at] = PARAGRAPH
            cuts[nxt.end()] = PARAGRAPH
    for m in _SENTENCE.finditer(text):
        cuts.setdefault(m.end(), SENTENCE)
    cuts.pop(0, None)
    cuts[len(text)] = PARAGRAPH
    atoms, start = [], 0
    for end in sorted(cuts):
        if end - start > room:
            atoms.extend(_forced(text, start, end, room))
            start = atoms[-1][1]
        atoms.append((start, end, cuts[end]))
        start = end
    return atoms


def _forced(text: str, start: int, end: int, room: int) -> Iterator[tuple[int, int, int]]:
    """Cuts at word ends (inside a word where it alone is too long) until at most room characters remain."""
    while end - start > room:
        cut = start + room
        if found := list(_WORD.finditer(text, start + room // 2, cut)):
            cut = found[-1].end()
        yield start, cut, WORD
        start = cut


def spans(text: str, room: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of pieces that cover text in order; each of at most room - overlap characters.

    Agglomerative: all atomic segments to begin with, adjacent pairs in a heap by (strength of their boundary,
    joint size, place); the weakest boundary goes first while the joint size plus the overlap fits the room. A pair
    that does not fit now never will, so every boundary leaves the heap for good or vanishes.
    """
    own = room - overlap
    atoms = _atoms(text, own)
    n = len(atoms)
    start, end = [a[0] for a in atoms], [a[1] for a in atoms]
    left, right = [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    alive = [True] * n
    heap = [(atoms[i][2], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    strength = [a[2] for a in atoms]
    heapq.heapify(heap)
    while heap:
        kind, size, i, j = heapq.heappop(heap)
        if not alive[i] or right[i] != j:
            continue
        now = end[j] - start[i]
        if now > own:
            continue
        if now != size:
            heapq.heappush(heap, (kind, now, i, j))
            continue
        end[i], strength[i], right[i], alive[j] = end[j], strength[j], right[j], False
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (strength[i], end[right[i]] - start[i], i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (strength[left[i]], end[i] - start[left[i]], left[i], i))
    return [(start[i], end[i]) for i in range(n) if alive[i]]


def _tail(text: str, start: int, at: int, overlap: int) -> int:
    """Where the overlap before at begins: the earliest sentence or word start within reach, after start."""
    low = max(start, at - overlap)
    if low >= at or overlap <= 0:
        return at
    if low == start:
        return low
    for pattern in (_LINE, _SENTENCE, _WORD):
        m = pattern.search(text, max(start, low - 1), at)
        if m and low <= m.end() < at:
            return m.end()
    return low


def split_item(heading: str | None, text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start of the shared part, start, end, piece) of one item; each piece carries the heading and fits limit.

    A heading longer than half the limit can't be repeated; it is split with the text, as its first paragraph.
    """
    head = f"{heading}\n" if heading else ""
    if len(head) > limit // 2:
        text, head = head + text, ""
    room = limit - len(head)
    overlap = max(0, min(overlap, room // 3))
    out, before = [], 0
    for start, end in spans(text, room, overlap):
        shared = _tail(text, before, start, overlap) if out else start
        out.append((shared, start, end, head + text[shared:end]))
        before = start
    return out


def split_oversized(
    df: DataFrame, key: str = "chunk_ix", heading: str = "heading", text: str = "text", limit: int = 1600, overlap: int = 120
) -> DataFrame:
    """Ordered pieces of every item of df larger than limit characters (heading, a line break and text).

    Rows: key, piece_no (from 1), pieces, shared_from, start, end (offsets in the text), piece. An item's pieces cover
    its text without gaps; up to overlap characters before a piece's start are shared with the one before. Items that
    fit, null texts and null keys give no row; repeated keys count once; other columns are ignored.

    Only items over the limit reach Python, one at a time, so no task holds more than an Arrow batch.
    """
    if limit < 16 or overlap < 0:
        raise ValueError("limit must be 16 or more and overlap not negative")
    size = F.length(text) + F.when(F.length(heading) > 0, F.length(heading) + 1).otherwise(0)
    big = once(df.where(size > limit).select(F.col(key).alias("_key"), F.col(heading).alias("_head"), F.col(text).alias("_text")), "_key")
    schema = f"_key {df.schema[key].dataType.simpleString()}, piece_no int, pieces int, shared_from int, start int, end int, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for k, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = split_item(h, t, limit, overlap)
                rows.extend((k, i, len(parts), *p) for i, p in enumerate(parts, 1))
            cols = list(zip(*rows)) or [[]] * 7
            types = [b.schema.field(0).type, *[pa.int32()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], ["_key", "piece_no", "pieces", "shared_from", "start", "end", "piece"]
            )

    return big.mapInArrow(run, schema).withColumnRenamed("_key", key)
