import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tendrel.llm import mojibake as m

CLEAN = [
    "Signs in Дорвино and Λερώνη were checked, with 7 labels of 5 Ω and 40 µm.",
    "The Welsh pages use ŵ and ŷ, as in tŷ gŵyl; others add ç, ñ and ø.",
    "Cooling was kept at 521 ±2 °C, about ½ the load that Señor Ruiz’s crew had measured.",
    "¿Cómo va a trasladar los 592 expedientes? Für Žatian; À-la-carte, Âge bands — “calm” – for £1,200 or €3…",
    "STAFF AT JUNDBRIÁXHOU BRIDGE AND MÜNCHEN WORK TO §12 OF THE PLAN.",
    "Le titulaire doit assurer à Łódź l'été, où Škoda œuvre.",
    "plain ASCII & <b>markup</b> 100% \\u",
    "",
]
TEXT = "The café pilot at Krêmôl cost £45,300 – “calm, clear” – and Señora Brøn’s team kept 12 °C."


@pytest.mark.parametrize("text", CLEAN)
def test_right_text_is_left_alone(text):
    assert m.examine(text)[:2] == (False, text)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"])
def test_utf8_read_as_something_else(wrong):
    garbled = b"".join(bytes([b]) for b in TEXT.encode()).decode(wrong, "replace") if wrong != "cp1252" else "".join(
        bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in TEXT.encode()
    )
    found, fixed, clean, _ = m.examine(garbled)
    assert found and fixed == TEXT and clean


def test_read_wrongly_twice():
    twice = TEXT.replace("”", "").encode().decode("latin-1").encode().decode("latin-1")
    assert m.examine(twice)[:2] == (True, TEXT.replace("”", ""))


@pytest.mark.parametrize("wrong", ["mac_roman", "cp437", "cp1251"])
def test_single_bytes(wrong):
    text = "The touché trial in Séîlvial gave a résumé, and Himást cost €5,400."
    found, fixed, _, _ = m.examine(text.encode("cp1252").decode(wrong))
    assert found and fixed == text


def test_lower_case_garbling():
    assert m.examine("a cafã© desk at horã»rk")[:2] == (True, "a café desk at horûrk")


def test_escapes():
    assert m.examine("a caf&Atilde;&copy; desk")[:2] == (True, "a café desk")


def test_lost_characters_are_found_but_not_complete():
    assert m.examine("The caf� pilot")[0::2] == (True, False)
    found, fixed, clean, _ = m.examine("He said â€œcalmâ€� to Krêmôl")
    assert found and not clean and "“calm" in fixed


def test_faults_of_several_kinds_in_one_passage():
    """A search that ends with states left goes on in parts, and says so where a part does too."""
    right = ["The café at Krêmôl", "the crèche at Zürich", "a résumé of Señora Brøn’s", "the fiancée of Jörg"]
    parts = [right[0].encode().decode("cp1252"), right[1].encode().decode("mac_roman"), right[2].encode().decode("cp437"), right[3].encode("cp1252").decode("mac_roman")]
    passage = ", ".join(parts)
    found, fixed, complete, _ = m.examine(passage)
    assert found and complete and fixed == ", ".join(right)
    *_, left = m.restore(passage, 1)
    assert left
    fixed, _, _, _, left = m.restore_in_parts(passage, 3)
    assert sum(r in fixed for r in right) >= 3


@pytest.mark.parametrize("wrong, least", [("cp1252", 0.97), ("latin-1", 0.97), ("mac_roman", 0.97), ("cp437", 0.97), ("cp850", 0.97), ("cp1250", 0.97), ("koi8_r", 0.97)])
def test_share_restored(wrong, least):
    """Sentences with foreign letters and signs read wrongly: the share that comes back exactly."""
    import random

    r = random.Random(wrong)
    words = "café résumé Zürich señora Brøn Łódź naïve façade Škoda Krêmôl crèche 12_°C £450 €30 “calm” – team’s plan desk cost".replace("_", "\xa0").split(" ")
    sentences = [" ".join(["The site at"] + [r.choice(words) for _ in range(6)] + ["was kept."]) for _ in range(120)]
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[byte] = bytes([byte]).decode(wrong)
        except UnicodeDecodeError:
            table[byte] = chr(byte)
    garbled = ["".join(chr(b) if b < 0x80 else table[b] for b in s.encode()) for s in sentences]
    pairs = [(s, g) for s, g in zip(sentences, garbled) if s != g and "�" not in g]
    found = [m.examine(g) for _, g in pairs]
    assert len(pairs) > 60 and all(f[0] for f in found)
    assert sum(f[1] == s for f, (s, _) in zip(found, pairs)) >= least * len(pairs)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_any_text_passes(text):
    found, fixed, _, _ = m.examine(text)
    assert isinstance(fixed, str) and (found or fixed == text)


def test_operator(frame):
    bad = "ein geprÃ¼fter Plan"
    rows = [("c", 1, bad, "z"), ("c", 1, bad, "z"), ("r", 1, "clean", "z"), ("r", None, bad, "z"), ("r", 2, None, "z"), ("r", 3, "", "z"), ("r", 4, "x " * 200_000 + bad, "z")]
    got = m.garbled_texts(frame(rows, "tab string, rec_id bigint, text string, restored string"), "tab", "rec_id").collect()
    assert sorted((r["tab"], r["rec_id"] or 0) for r in got) == [("c", 1), ("r", 0), ("r", 4)]
    assert all(r["restored"].endswith("ein geprüfter Plan") and r["complete"] for r in got)
    assert m.garbled_texts(frame([], "tab string, rec_id bigint, text string"), "tab", "rec_id").collect() == []
