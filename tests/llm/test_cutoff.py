import random

import pytest

from tendrel.llm import cutoff as c

SCHEMA = "doc_id bigint, text string, source string, kind string"


@pytest.mark.parametrize("text, kind", [
    ("All is said.", c.CLOSED), ("All is said (see lot 4)", c.CLOSED), ("“All is said.”", c.CLOSED), ("Name of bidder: ..............", c.CLOSED), ("More will follow, and so on ...", c.CLOSED), ("desks, phones etc.", c.CLOSED),
    ("Sign here: ______", c.CLOSED), ("A sentence. ...", c.CLOSED), ("cut in mid wor...", c.CUT), ("cut in mid wor…", c.CUT), ("We agreed with [...]", c.CUT), ("the rest (truncated)", c.CUT), ("costs of £41,", c.CUT), ("half a sign �", c.CUT),
    ("no stop at the end", c.OPEN), ("cut before a ", c.OPEN), ("padded  ", c.OPEN), ("line end \n", c.OPEN), ("All is said. ", c.CLOSED), ("- a list item", c.OPEN), ("", c.BLANK), (" \n\xa0", c.BLANK), (None, c.BLANK),
])
def test_endings(text, kind):
    assert c.ending(text)[0] == kind


@pytest.mark.parametrize("text, form", [("First line.\n- a list item", c.ITEM), ("x | y | z", c.ROW), ("It is done.\nKind regards\nThe bid office", c.SIGNED), ("It is done.\nRelease Planning\nThe", c.LONE), ("It is done.\nThe grants console logs are kept for many years by", c.SENTENCE), ("3.1.2 The Supplier shall", c.SENTENCE), ("# Head", c.LONE)])
def test_last_lines(text, form):
    assert c.last_line(text) == form


def test_alignment():
    full = "one two three four five six seven eight nine ten. Eleven twelve."
    assert c.continues("one two three four five six seven eight ni", full) is True
    assert c.continues("one two three four five six seven eight nine", full) is True
    assert c.continues("one two three four five six seven eight nine ten", full) is False
    assert c.continues("one two three four five six seven eight nine te...", full) is True
    assert c.continues("something else entirely that is long enough for a look", full) is None
    assert c.continues(full, full) is None


def corpus(n=400, seed=3):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    last = [f"end{chr(97 + i)}" for i in range(8)]
    sentence = lambda: " ".join(r.choice(words) for _ in range(9)).capitalize() + " " + r.choice(last) + "."
    return [(i, " ".join(sentence() for _ in range(12)), f"s{i % 3}", "x") for i in range(n)]


def test_operator(frame):
    docs = corpus()
    texts = {i: t for i, t, *_ in docs}
    cut = {1000 + i: texts[i][: len(texts[i]) - 30 - i % 7].rstrip(" .") for i in range(20)}  # ends in mid sentence
    rows = docs + [(k, t, "cutter", "x") for k, t in cut.items()]
    rows += [(2000 + i, texts[i][:-1], "s0", "x") for i in range(30, 40)]  # only the stop is missing
    rows += [rows[0], rows[0], (3000, None, "s1", "x"), (3001, " ", "s1", "x"), (None, "cut he", "s1", "x"), (3002, texts[5] + " and more wa...", None, "x"), (3003, "x " * 100_000 + "end.", "s1", "x")]
    got = {r["doc_id"]: r for r in c.cut_off(frame(rows, SCHEMA)).collect()}
    assert set(got) == {r[0] for r in rows} - {None, 3000, 3001}
    found = {k for k, r in got.items() if r["truncated"]}
    assert found >= {3002} and not found & set(texts) and 3003 not in found
    assert len(found & set(cut)) >= 19
    assert not found & set(range(2030, 2040))
    rates = {r["source"]: r for r in c.source_rates(c.cut_off(frame(rows, SCHEMA))).collect()}
    assert rates["cutter"]["documents"] == 20 and rates[None]["truncated"] == 1 and rates["s2"]["truncated"] == 0


def test_near_copies_decide(frame):
    docs = corpus(60, 5)
    long = " ".join(t for _, t, *_ in docs[:6])
    rows = docs + [(900, long, "a", "x"), (901, long[:-40].rstrip(), "b", "x"), (902, long[:-1], "b", "x")]
    got = {r["doc_id"]: r for r in c.cut_off(frame(rows, SCHEMA)).collect()}
    assert got[901]["aligned"] is True and got[901]["truncated"] and got[902]["truncated"] is False and not got[900]["truncated"]


def test_shortened_copies_are_found_by_alignment(frame):
    """Copies of long texts under another source, cut inside a sentence at 50 to 95 % of their length, some with words
    changed: the copy decides, at words that end sentences everywhere."""
    r = random.Random(11)
    docs = corpus(240, 11)
    long = {i: " ".join(docs[(7 * i + j) % 240][1] for j in range(r.randrange(1, 5))) for i in range(120)}
    rows, want = [(i, t, "own", "x") for i, t in long.items()], set()
    for i, t in long.items():
        cut = t[: int(len(t) * r.uniform(0.5, 0.95))].rstrip()
        words = cut.split()
        for _ in range(len(words) // 100):
            words[r.randrange(len(words) - 10)] = f"x{r.randrange(10**6)}"
        words = words[:-1] if i % 2 else words  # at a word's end or inside it
        while words[-1].endswith("."):
            words = words[:-1]
        rows.append((1000 + i, " ".join(words), "copy", "x"))
        want.add(1000 + i)
        # complete copies of the first sentences whose stop was lost
        whole = t.split(". ")
        rows.append((2000 + i, ". ".join(whole[: len(whole) * 3 // 4]), "bare", "x"))
    got = {x["doc_id"]: x for x in c.cut_off(frame(rows, SCHEMA)).collect()}
    by_copy = {k for k, x in got.items() if x["decided_by"] == "copy" and x["truncated"]}
    assert len(by_copy & want) >= 0.97 * len(want) and len(by_copy & want) >= 0.97 * len(by_copy)
    assert sum(got[2000 + i]["decided_by"] == "copy" and not got[2000 + i]["truncated"] for i in long) >= 0.97 * len(long)


def test_copies_show_cuts_behind_brackets_and_numbers(frame):
    docs = corpus(40, 13)
    full = docs[0][1] + " The desk answers within 4.5 hours (in all lots) and keeps count of what it has answered."
    rows = docs + [(900, full, "a", "x"), (901, full[: full.index("5 hours")], "b", "x"), (902, full[: full.index(" and keeps")], "b", "x"), (903, docs[1][1] + " All is kept (see lot 4)", "b", "x")]
    got = {x["doc_id"]: x for x in c.cut_off(frame(rows, SCHEMA)).collect()}
    assert [(got[i]["kind"], got[i]["truncated"], got[i]["decided_by"]) for i in (901, 902, 903)] == [(c.CLOSED, True, "copy"), (c.CLOSED, True, "copy"), (c.CLOSED, False, "end")]


def test_single_trailing_blank_is_no_cut_by_itself(frame):
    docs = corpus(60, 15)
    rows = docs[1:] + [(900, "All is said.\nYours sincerely\nJane Smith ", "a", "x"), (901, docs[0][1][:-30].rstrip(" .") + " ", "a", "x")]
    got = {x["doc_id"]: x for x in c.cut_off(frame(rows, SCHEMA)).collect()}
    assert not got[900]["truncated"] and got[901]["truncated"] and got[901]["decided_by"] == "words"


def test_field_limits(frame):
    """Texts that end at one length in one source are cut there, even at a word that often ends sentences."""
    docs = corpus(300, 7)
    rows = [(i, t[:600] if i % 3 == 0 else t, s, "x") for i, t, s, _ in docs]
    got = {r["doc_id"]: r for r in c.cut_off(frame(rows, SCHEMA)).collect()}
    want = {i for i, t, s, _ in rows if len(t) == 600 and t[-1] not in ". "}
    assert {k for k, r in got.items() if r["truncated"]} >= want and all(got[k]["at_limit"] for k in want)


def test_empty(frame):
    assert c.cut_off(frame([], SCHEMA)).collect() == []


def test_padding_and_long_last_lines(frame):
    """Blanks behind a text and the length of its last line don't change what it is."""
    docs = corpus(200, 9)
    cut = docs[0][1][:-30].rstrip(" .")
    item = "It is done.\n- " + docs[1][1].replace(".", "")[:1100] + " " + docs[2][1].replace(".", "")[:600].rstrip()
    rows = docs + [(900, cut, "a", "x"), (901, cut + " " * 1500, "b", "x"), (902, cut + "\xa0" * 999 + " ", "b", "x"), (903, cut + " ", "b", "x"), (904, item, "b", "x"), (905, "All is said." + " " * 3000, "b", "x"), (906, " " * 3000, "b", "x")]
    got = {r["doc_id"]: r for r in c.cut_off(frame(rows, SCHEMA)).collect()}
    assert {got[i]["kind"] for i in (900, 901, 902)} == {c.OPEN} and got[901]["truncated"] == got[902]["truncated"] == got[900]["truncated"]
    assert got[903]["kind"] == c.OPEN and got[903]["truncated"] and got[904]["line"] == c.ITEM and got[905]["kind"] == c.CLOSED and 906 not in got
    rates = {r["source"]: r["documents"] for r in c.source_rates(c.cut_off(frame(rows, SCHEMA))).collect()}
    assert rates["b"] == 5
