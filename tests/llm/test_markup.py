import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tendrel.llm import markup as m

PLAIN = [
    "Answer time is < 49 minutes and > 52% of calls are kept.", "See <insert site name> and {site} in form 8.", "2 * 60 = 120 and 3 == 3 in the sheet.", "Routes A->B and B=>C take 4 + 8 minutes -- on most days.",
    "Sites A & B use file_name_7_v12.xlsx and C# tools.", "Costs marked * leave out tax of $9,540. Others cost $5.", "Option [4] costs $32 or 32^2 points; more cost $40.", "[PLACEHOLDER: figure for site 21] is still to come.",
    "Folder C:\\Bids\\58\\final holds #70.", "- a dash list\n- of two items\n1. and numbers", "Change Control | The Supplier shall act. | Mandatory", "Name: ______ and (see note 4)", "", "x < y > z & more",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_left_alone(text):
    assert m.clean(text) == (text, [])


@pytest.mark.parametrize("text, kind, want", [
    ("<p>The <b>Supplier</b> must act.</p>", "html", "The Supplier must act."),
    ("a<!-- note 4 -->b", "html", "ab"),
    ("one &amp; two&nbsp;three &ldquo;x&rdquo;", "html", "one & two\xa0three “x”"),
    ("less<br/> than", "html", "less\n than"),
    ("<h2 class=x>Head</h2>\n<ul><li>one</li><li>two</li></ul>", "html", "## Head\n\n- one\n\n- two"),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>", "html", "a | b\nc | d"),
    ("A<sub>7</sub> = 1 &minus; d<sup>2</sup>", "html", "A_7 = 1 − d^2"),
    ("<pre><code>if a &gt; 1:\n  b</code></pre>", "html", "```\nif a > 1:\n  b\n```"),
    ("The **Supplier** must *act* on ~~old~~ `code` and __this__ and _that_.", "markdown", "The Supplier must act on old code and this and that."),
    ("See [this](a/b.md), [that][4] and ![pic](i.png).", "markdown", "See this, that and pic."),
    ("Head\n----\nbody of text", "markdown", "# Head\nbody of text"),
    ("## Head ##\nbody", "markdown", "## Head\nbody"),
    ("- [x] done\n- [ ] open", "markdown", "- done\n- open"),
    ("> quoted", "markdown", "quoted"),
    ("| a | b |\n|---|:--|\n| c | d |", "markdown", "a | b\nc | d"),
    ("~~~\nx * y * z\n~~~", "markdown", "```\nx * y * z\n```"),
    ("The [[Page 8|Supplier]] must '''act''' on {{nowrap|it}} ''now''.", "wiki", "The Supplier must act on it now."),
    ("== Head ==\n** item", "wiki", "# Head\n  - item"),
    ("h2. Head", "wiki", "## Head"),
    ("{code}\nx\n{code}", "wiki", "```\nx\n```"),
    ("{| class=\"t\"\n| a || b\n|-\n| c || d\n|}", "wiki", "a | b\nc | d"),
    ("{{math|A {{=}} 1 - d}}", "wiki", "$A = 1 - d$"),
    ("a {color:red}b{color} c", "wiki", "a b c"),
    ("\\section{Head}\nThe \\textbf{Supplier} must~\\cite{r} act\\footnote{Page 2.}.", "latex", "# Head\nThe Supplier must act (Page 2.)."),
    ("\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}", "latex", "- one\n- two"),
    ("kept at 28\\% since $t_{6} \\leq 9$", "latex", "kept at 28% since $t_{6} \\leq 9$"),
    ("\\begin{tabular}{ll}\na & b \\\\\nc & d \\\\\n\\end{tabular}", "latex", "a | b\nc | d"),
    ("\\begin{verbatim}\na \\b\n\\end{verbatim}", "latex", "```\na \\b\n```"),
    ("\\[ A = \\frac{d}{2} \\]", "latex", "$$ A = \\frac{d}{2} $$"),
])
def test_conversion(text, kind, want):
    got, kinds = m.clean(text)
    assert kinds == [kind] and got == want


def test_several_languages():
    assert m.clean("a **b** and <i>c</i>")[1] == ["html", "markdown"]


def test_shared_signs_follow_their_neighbours():
    assert [x[3] for x in m.label_blocks("'''wiki''' line here\n* item\n# item")] == ["wiki"] * 3
    assert [x[3] for x in m.label_blocks("**bold** line here\n* item\n# item")] == ["markdown"] * 3
    assert [x[3] for x in m.label_blocks("* item\n- other")] == ["", ""]
    roles = [x[2] for x in m.label_blocks("This is a long line of running text with the usual small words in it, and so it is prose.\n[[a]] [[b]] [[c]] [[d]] [[e]] [[f]] [[g]] [[h]] [[i]]")]
    assert roles == ["prose", "furniture"]


PROSE = "The register of all the sites is kept by the supplier and it is checked in each of the months of the term."


def test_blocks_decide_what_is_found():
    """A hash at the start of a line is a wiki list next to wiki lines, and a heading next to prose: length and density of
    stop words of the line between decide."""
    assert m.kinds("'''wiki''' line here\n# item") == ["wiki"]
    assert m.clean("'''wiki''' line here\n# item")[0] == "wiki line here\n- item"
    assert m.kinds(f"'''wiki''' line here\n{PROSE}\n# item") == ["markdown", "wiki"]
    assert m.clean(f"'''wiki''' line here\n{PROSE}\n# item")[0] == f"wiki line here\n{PROSE}\n# item"
    for thin in (PROSE[:50], " ".join(w for w in PROSE.split() if w.lower() not in m.STOPWORDS) + " " + "x" * 60):
        assert m.kinds(f"'''wiki''' line here\n{thin}\n# item") == ["wiki"]


@pytest.mark.parametrize("name, value", [("PROSE_STOPS", 0.9), ("PROSE_SIZE", 500), ("LINKS", 1.1)])
def test_each_feature_changes_the_result(monkeypatch, name, value):
    text = f"'''wiki''' line here\n{PROSE}\n# item\n[Home page](/) [Tenders](/t) [Contact us](/c) [Sitemap](/s)\n[Up](/)"
    before = m.clean(text)
    monkeypatch.setattr(m, name, value)
    assert m.clean(text) != before


def test_furniture_goes():
    menu = "[Home page](/) | [Tenders](/tenders) | [Contact us](/contact) | [Sitemap](/map)"
    assert m.clean(f"{menu}\n[Up](/)\n{PROSE}\nSee [Annex 3](a3.html) and [Annex 4](a4.html).\n- [Form A](a.html)\n| [B](b) | [C](c) |\n{menu}") == (f"{PROSE}\nSee Annex 3 and Annex 4.\n- Form A\nB | C", ["markdown"])
    # a short link next to text belongs to it
    assert m.clean(f"{PROSE}\n[Up](/)\n{PROSE}")[0] == f"{PROSE}\nUp\n{PROSE}"


def test_underlined_headings_stay_whole():
    assert m.clean(f"'''wiki''' here\nHead of it\n----------\n{PROSE}")[0] == f"wiki here\n# Head of it\n{PROSE}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab <>/&;*_`~[](){}|'=#\\$%^-\n!h2."), max_size=120))
def test_any_text_passes(text):
    out, kinds = m.clean(text)
    assert isinstance(out, str) and set(kinds) <= set(m.KINDS)
    assert kinds or out == text


def test_operator(frame):
    rows = [("c", 1, "a **b** c", "z"), ("c", 1, "a **b** c", "z"), ("c", 2, "plain", "z"), ("c", 3, None, "z"), ("c", 4, "", "z"), (None, 5, "<b>x</b>", "z"), ("c", 6, "word " * 100_000 + "**b**", "z")]
    got = {(r["tab"], r["rec_id"]): r for r in m.markup_texts(frame(rows, "tab string, rec_id bigint, text string, markup string"), "tab", "rec_id").collect()}
    assert set(got) == {("c", 1), (None, 5), ("c", 6)} and got["c", 1]["clean"] == "a b c" and got[None, 5]["markup"] == ["html"]
    assert m.markup_texts(frame([], "tab string, rec_id bigint, text string"), "tab", "rec_id").collect() == []


@pytest.mark.parametrize("text", [t for t in ("<td>x", "a_b_ _c_", "h1. x", "|-\n", "x\n---\n", "&lt;", "$$x$$", "![a](b)", "=== a ===")])
def test_prefilter_lets_markup_through(spark, text):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").where(F.col("t").rlike(m.CANDIDATE)).count() == 1


LONG = "many words of a paragraph " * 40 + "end"


@pytest.mark.parametrize("text, kind, want", [
    (f"**{LONG}**", "markdown", LONG), (f"_{LONG}_", "markdown", LONG), (f"~~{LONG}~~", "markdown", LONG), (f"`{LONG}`", "markdown", LONG), (f"''{LONG}''", "wiki", LONG),
    (f"\\({LONG}\\)", "latex", f"${LONG}$"), (f"\\[ {LONG} \\]", "latex", f"$$ {LONG} $$"), (f"$a = {LONG}$", "latex", f"$a = {LONG}$"),
])
def test_long_signs(text, kind, want):
    assert m.clean(text) == (want, [kind])


def test_unclosed_signs_stay_fast():
    import time

    began = time.monotonic()
    for sign in ("\\(", "\\[", " *a", " _a", " `a", "$a\\", "''a ", "~~a"):
        m.kinds(sign * 20_000)
    assert time.monotonic() - began < 30


def test_prefilter_covers_conversion(spark):
    """Whatever has a sign reaches Python."""
    from pyspark.sql import functions as F

    texts = [c[0] for c in test_conversion.pytestmark[0].args[1]] + ["- [x] done", "  + [ ] open", "a|b\n--|--\nc|d", "h1.\tHead", f"\\[{LONG}\\]"]
    assert all(m.kinds(t) for t in texts)
    left = spark.createDataFrame([(t,) for t in texts], "t string").where(~F.col("t").rlike(m.CANDIDATE)).collect()
    assert left == []
