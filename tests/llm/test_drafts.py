import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tendrel.llm import drafts as d
from tendrel.llm.language import language

ASK = "The Supplier shall replace faulty tablets at Quoustou within 12 minutes and record this in the case file store."
GOOD = "A named records officer leads the change board and reviews the carbon report with the customer each month."
GERMAN = "Die Daten werden in Graembrux gespeichert, verschlüsselt und nach 8 Wochen gelöscht."


@pytest.mark.parametrize("answer", [None, "", " \n\xa0", "​", "N/A", "tbd", "--", "...", "?", "[ ]", "(blank)", "<p></p>", "Answer:", "xxx", "To follow", "[PLACEHOLDER: answer]", "&nbsp;"])
def test_empty(answer):
    assert d.defect(answer, True, "", ASK) == "empty"
    assert d.defect(answer, False, "Needs the number.", ASK) is None
    assert d.defect(answer, False, " ", ASK) == "empty"
    assert d.defect(answer, None, "Needs the number.", ASK) == "empty"


@pytest.mark.parametrize("answer", [
    "I cannot answer this requirement from the extracts.", "Sorry, no response can be written for this item.", "Thank you for the question. Unable to respond.", "We must decline to answer storage. A member of the bid team should look at it.",
    "Je ne peux pas répondre à cette exigence à partir des extraits.", "Auf Grundlage der Auszüge ist keine Antwort möglich.", "No es posible redactar una respuesta para este punto.", "As a drafting assistant I am not able to give commitments.",
])
def test_refusal(answer):
    assert d.defect(answer, True, None, ASK) == "refusal"
    assert d.defect(answer, False, "Needs the number.", ASK) is None


@pytest.mark.parametrize("answer", [
    ASK, ASK.upper(), ASK.replace(" ", "  "), ASK.replace("shall", "will"), f"Q: {ASK}", f"R-009 {ASK}", f"Requirement noted: {ASK}", f"The Supplier has read the following. {ASK}", f"{ASK} {ASK}", ASK[:-1] + ";", ASK[:70],
])
def test_copied(answer):
    assert d.defect(answer, True, None, ASK) == "copied"
    assert d.defect(answer, False, "a note", "<p>" + ASK.replace("tablets", "<b>tablets</b>") + "</p>") == "copied"


@pytest.mark.parametrize("answer", [f'"{ASK}" {GOOD}', GOOD, "Yes. See the licence statement for Trorpria.", "Confirmed. Held under PLM-12 Silver since 2018.", f"{GOOD} Measures are:\n- call time\n- queue length", f"{GOOD} (see lot 3)", f"{GOOD} [PLACEHOLDER: number]", f"{GERMAN} {GOOD} {GOOD}"])
def test_sound_answers(answer):
    assert d.defect(answer, True, "", ASK) is None
    assert d.defect(answer, True, "", None) is None


def test_other_language():
    assert d.defect(GERMAN, True, "", ASK) == "other_language"
    assert d.defect(GERMAN, False, "a note", ASK) == "other_language"
    assert d.defect(GERMAN, True, "", "Der Auftragnehmer muss Störungen in Chi innerhalb von 8 Minuten melden.") is None
    assert d.defect("Zespół w Tirro wymienił 263 urządzeń bez przerwy w pracy urzędu.", True, "", ASK) == "other_language"
    assert language("Zxqv brrt") is None and language(None) is None


@pytest.mark.parametrize("end", ["The restore log is updated by the", "Data is held at Traedro…", "The Supplier tra...", "Credits of £41,", "(see the", "Staff cannot open the libr"])
def test_truncated(end):
    assert d.defect(f"{GOOD} {end}", True, "", ASK) == "truncated"


def test_automaton_covers_shared_runs():
    a = d.SuffixAutomaton("a b c d a b x".split())
    assert a.covered("z a b c q a b x a".split()) == [False, True, True, True, False, True, True, True, False]
    assert d.SuffixAutomaton([]).covered(["a"]) == [False]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_automaton_against_brute_force(known, seen):
    runs = {tuple(known[i:j]) for i in range(len(known)) for j in range(i + 3, len(known) + 1)}
    want = [False] * len(seen)
    for i in range(len(seen)):
        for j in range(i + 3, len(seen) + 1):
            if tuple(seen[i:j]) in runs:
                want[i:j] = [True] * (j - i)
    assert d.SuffixAutomaton(known).covered(seen) == want


def test_rules_with_gaps():
    from tendrel.llm.refusals import Kinds

    k = Kinds({"not": "cannot|can not", "say": "answer"})
    rule = (("not", 2, "say"),)
    assert k.matches("i cannot answer".split(), rule) and k.matches("i can not fully now answer".split(), rule)
    assert not k.matches("i cannot in any way at all answer".split(), rule) and not k.matches("answer cannot".split(), rule) and not k.matches([], rule)


def test_delimiters():
    assert d.open_delimiters('a (b [c] "d') == ["(", '"'] and d.open_delimiters("(a) “b”") == []


def test_operator(frame):
    req = frame([("T", "R-1", ASK, 9), ("T", "R-1", ASK, 9), ("T", "R-2", None, 9), (None, "R-3", ASK, 9)], "tender_id string, id string, text string, answer int")
    rows = [(1, "T", "R-1", "", True, "", ""), (1, "T", "R-1", "", True, "", ""), (2, "T", "R-1", ASK, True, None, ""), (3, "T", "R-2", "I cannot answer this requirement.", None, None, ""), (4, "T", "R-9", None, False, None, ""),
            (5, None, None, GOOD, True, None, ""), (6, "T", "R-1", GOOD, None, None, ""), (None, "T", "R-1", "", True, "", ""), (7, "T", "R-1", "word " * 100_000 + "of the", True, "", "")]
    schema = "draft_id bigint, tender_id string, requirement_id string, answer string, evidence_sufficient boolean, note string, asked string"
    got = {(r["draft_id"], r["defect"]) for r in d.broken_drafts(frame(rows, schema), req).collect()}
    assert got == {(1, "empty"), (2, "copied"), (3, "refusal"), (4, "empty"), (7, "truncated")}
    assert d.broken_drafts(frame([], schema), req).collect() == []


def test_refusals_in_other_words():
    import refusal_lists as r

    for refusals, others in ((r.REFUSALS, r.LOOK_ALIKES), (r.SECOND, r.SECOND_LOOK_ALIKES), (r.THIRD, r.THIRD_LOOK_ALIKES)):
        hits, wrong = sum(map(d.is_refusal, refusals)), sum(map(d.is_refusal, others))
        assert hits >= 0.9 * len(refusals) and hits >= 0.95 * (hits + wrong)


def test_fillers_are_whole_words():
    assert d._FILLS.sub(" ", "data storage area at the quarry") == "data storage area at the quarry"
    assert d._FILLS.sub(" ", "q the quarry a") .split() == ["the", "quarry"]


def test_a_refusal_beside_an_answer_is_none():
    assert d.is_refusal("Thank you for the question. I cannot answer this requirement. Please ask the buyer.")
    assert not d.is_refusal("I cannot answer this requirement for lot 2. In lot 1 the desk is staffed day and night by two clerks who log each call in the tool.")
    assert not d.is_refusal("Please ask the buyer.") and not d.is_refusal("")
