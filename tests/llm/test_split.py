import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tendrel.llm.split import split_item, split_oversized


def check(heading, text, limit, overlap):
    head = f"{heading}\n" if heading else ""
    whole = head + text if len(head) > limit // 2 else text
    pieces = split_item(heading, text, limit, overlap)
    assert "".join(whole[a:b] for _, a, b, _ in pieces) == whole
    for (s, a, b, p), before in zip(pieces, [None, *pieces]):
        assert len(p) <= limit and 0 <= a - s <= overlap
        assert p.endswith(whole[s:b])
        if before:
            assert before[1] < s or s == a or s >= before[1]
        if len(head) <= limit // 2:
            assert p.startswith(head)
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n\r!é"), max_size=600), st.text(alphabet="Hd ", max_size=30), st.integers(16, 120), st.integers(0, 40))
def test_pieces_cover_the_text(text, heading, limit, overlap):
    check(heading, text, limit, overlap)


def test_natural_boundaries_come_first():
    text = "\n\n".join("One sentence here. Another sentence there." for _ in range(6))
    for _, a, b, _ in check("H", text, 100, 10)[:-1]:
        assert text[:b].endswith("\n\n")
    lines = "\n".join("a line of words without any stop" for _ in range(9))
    assert all(lines[:b].endswith("\n") for _, _, b, _ in check("", lines, 80, 10)[:-1])
    sentences = "A short sentence. " * 20
    assert all(sentences[:b].endswith(". ") for _, _, b, _ in check("", sentences, 80, 20)[:-1])


@pytest.mark.parametrize("text", ["x" * 5000, "word " * 900, "\n" * 3000, "a.\n\n" * 900, " " * 2000])
def test_texts_without_boundaries(text):
    assert len(check("Head", text, 200, 30)) > 1
    check("h" * 400, text, 200, 30)


def test_operator(frame):
    long = "A sentence of words. " * 120
    rows = [(1, "H", long, "x"), (1, "H", long, "x"), (2, None, long, "x"), (3, "", "short", "x"), (4, "H", None, "x"), (None, "H", long, "x"), (5, None, "y" * 1600, "x"), (6, "h", "y" * 1599, "x"), (7, "", "", "x")]
    got = split_oversized(frame(rows, "chunk_ix bigint, heading string, text string, piece string")).collect()
    assert {r["chunk_ix"] for r in got} == {1, 2, 6}
    for k in (1, 2, 6):
        own = sorted((r for r in got if r["chunk_ix"] == k), key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in own] == list(range(1, own[0]["pieces"] + 1))
    assert split_oversized(frame([], "chunk_ix bigint, heading string, text string")).collect() == []
    with pytest.raises(ValueError):
        split_oversized(frame(rows, "chunk_ix bigint, heading string, text string, piece string"), limit=3)
