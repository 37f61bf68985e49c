import io
import zipfile
import zlib

import pytest

from tendrel import cli
from tendrel.sources import readers
from tendrel.streaming import watch as w

PROSE = "The Supplier keeps a staffed service desk every day of the year for all users."


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    ns = 'xmlns:w="http://x/w"'
    para = lambda *runs: "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"
    cell = lambda t: f"<w:tc>{para(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('Ref')}{cell('Clause')}</w:tr><w:tr>{cell('4.1')}{cell('The Supplier shall hold cover.')}</w:tr></w:tbl>"
    return zipped({"word/document.xml": f"<w:document {ns}><w:body>{para('Split ', 'over runs')}{table}</w:body></w:document>"})


def xlsx():
    shared = "<sst><si><t>Ref</t></si><si><t>Ask</t></si><si><t>The Supplier </t><t>must act.</t></si></sst>"
    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>12</v></c><c/><c t="s"><v>2</v></c><c t="inlineStr"><is><t>inline</t></is></c><c t="s"><v>99</v></c></row></sheetData></worksheet>'
    return zipped({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet})


def pdf(content, flate=True, trailer=b""):
    body = zlib.compress(content) if flate else content
    return b"%PDF-1.4\n1 0 obj\n<< /Length 1 >>\nstream\n" + body + b"\nendstream\nendobj\ntrailer " + trailer + b"\n%%EOF"


def shown(*lines):
    return b"BT " + b" ".join(b"1 0 Td (%s) Tj" % x for x in lines) + b" ET"


def test_office_files():
    assert readers.read_bytes("a.docx", docx()) == "Split over runs\nRef | Clause\n4.1 | The Supplier shall hold cover."
    assert readers.read_bytes("a.XLSX", xlsx()) == "Ref | Ask\n12 | The Supplier must act. | inline"


@pytest.mark.parametrize("flate", [True, False])
def test_pdf_text(flate):
    got = readers.read_bytes("a.pdf", pdf(shown(PROSE.encode(), rb"nested (brackets \) and \\ and \101) kept here, in one line"), flate))
    assert got == PROSE + "\nnested (brackets ) and \\ and A) kept here, in one line"


def test_pdf_hex_strings():
    hexed = PROSE.encode("utf-16-be").hex().encode()
    assert readers.read_bytes("a.pdf", pdf(b"BT << /X (no) >> <" + hexed + b"> Tj ET")) == PROSE


@pytest.mark.parametrize("name, data, words", [
    ("a.docx", b"\xd0\xcf\x11\xe0" + b"0" * 50, "Save As"),
    ("a.docx", b"", "empty"),
    ("a.docx", zipped({"word/document.xml": "<w><open>"}), "damaged"),
    ("a.docx", zipped({"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x/>"}), "type declarations"),
    ("a.docx", zipped({"other.xml": "<a/>"}), "Word document"),
    ("a.xlsx", b"plain text", "Save As"),
    ("a.xlsx", zipped({"xl/x.xml": "<a/>"}), "worksheets"),
    ("a.rtf", b"x", "no reader"),
    ("a.pdf", b"no header", "not a PDF"),
    ("a.pdf", pdf(b"q 1 0 0 1 0 0 cm /Im Do Q", False), "scanned"),
    ("a.pdf", pdf(shown(PROSE.encode()), trailer=b"<< /Encrypt 5 0 R >>"), "password"),
    ("a.pdf", pdf(shown(b"#$%&@!*+=" * 12)), "unreadable"),
])
def test_failures_name_the_file_and_a_remedy(name, data, words):
    with pytest.raises(readers.Unreadable) as e:
        readers.read_bytes(name, data)
    assert name in str(e.value) and words in str(e.value)


@pytest.fixture()
def folder(tmp_path):
    corpus = tmp_path / "corpus"
    (corpus / "sub").mkdir(parents=True)
    (corpus / "good.md").write_text("﻿# Service Desk\n" + PROSE + "\n# Backup\nBackups of the register are copied to a second site every night and restored in drills.\n", "utf-8")
    (corpus / "sub" / "_also.md").write_text("Availability of the portal was held at 99 percent over the last five years of service.\n")
    (corpus / "ruined.docx").write_bytes(b"no zip")
    (corpus / "zero.docx").write_bytes(b"")
    (corpus / "blank.md").write_text(" \n")
    (corpus / "notes.rtf").write_text("x")
    (corpus / "helper").write_text("x")
    return corpus


def test_corpus_skips_nothing_silently(spark, folder):
    chunks, skipped = readers.load_corpus(spark, folder)
    rows = chunks.orderBy("chunk_ix").collect()
    assert [(r["chunk_ix"], r["doc"], r["heading"]) for r in rows] == [(0, "good.md", "Service Desk"), (1, "good.md", "Backup"), (2, "_also.md", "")]
    assert "desk" in rows[0]["tokens"]
    assert {r["name"] for r in skipped.collect()} == {"ruined.docx", "zero.docx", "blank.md", "notes.rtf"}
    assert all(r["reason"] for r in skipped.collect())


def test_fingerprint_follows_changes(folder):
    before = readers.fingerprint(folder)
    (folder / "good.md").write_text("# New\n" + PROSE)
    assert readers.fingerprint(folder) != before
    assert readers.fingerprint(folder / "missing") == readers.fingerprint(folder / "missing")


def tender(path):
    path.write_text("# Tender\n1.1 The Supplier shall keep a staffed service desk every day.\n1.2 The Supplier must fly to the moon in balloons.\n")
    return path


def test_command_line(spark, folder, tmp_path, capsys):
    rfp, out = tender(tmp_path / "rfp.md"), tmp_path / "out"
    assert cli.main([]) == 2
    assert cli.main(["tender", "run", "--rfp", str(rfp), "--corpus", str(folder), "--answered-at", "0.3", "--weak-at", "0.5"]) == 2
    assert cli.main(["tender", "run", "--rfp", str(tmp_path / "none.md"), "--corpus", str(folder)]) == 2
    (tmp_path / "empty.md").write_text("nothing")
    assert cli.main(["tender", "run", "--rfp", str(tmp_path / "empty.md"), "--corpus", str(folder)]) == 3
    (tmp_path / "bare").mkdir()
    assert cli.main(["tender", "run", "--rfp", str(rfp), "--corpus", str(tmp_path / "bare")]) == 4
    capsys.readouterr()
    assert cli.main(["tender", "run", "--rfp", str(rfp), "--corpus", str(folder), "--out", str(out)]) == 0
    assert "ruined.docx" in capsys.readouterr().err
    csv = (out / "coverage.csv").read_text("utf-8-sig").splitlines()
    assert csv[0] == "id,ref,obligation,verdict,critical,coverage,requirement,evidence,source_line" and csv[1].startswith("R-002,1.2,BINDING,GAP,YES")
    assert "⚑" in (out / "coverage.md").read_text("utf-8") and "<table>" in (out / "coverage.html").read_text("utf-8")
    assert cli.main(["tender", "draft", "--rfp", str(rfp), "--corpus", str(folder), "--out", str(out), "--dry-run"]) == 0
    shown_ = capsys.readouterr().out
    assert "R-001" in shown_ and "balloons" not in shown_.split("--- batch")[1]
    assert cli.main(["tender", "draft", "--rfp", str(rfp), "--corpus", str(folder), "--out", str(out)]) == 5


class Client:
    def draft(self, prompt, kind, effort="high"):
        return '{"drafts":[{"id":"R-001","answer":"Held.","evidence_sufficient":true,"note":""}]}' if kind == "tender" else '{"drafts":[]}'


def test_drafts_and_grants(spark, folder, tmp_path):
    rfp, out = tender(tmp_path / "rfp.md"), tmp_path / "out"
    assert cli.main(["tender", "draft", "--rfp", str(rfp), "--corpus", str(folder), "--out", str(out)], Client()) == 0
    assert "Held." in (out / "drafts.md").read_text("utf-8")
    call = tmp_path / "call.md"
    call.write_text("1) Describe your service desk and how it is staffed every day. (max 300 words, worth 10 marks)\n2) What risks do you see in balloons?\n")
    assert cli.main(["grant", "write", "--call", str(call), "--library", str(folder), "--out", str(out)]) == 0
    assert "S-002" in (out / "application.md").read_text("utf-8") and (out / "sections.csv").exists() and (out / "analysis.md").exists()


def test_watch(spark, folder, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    tender(inbox / "good one.md")
    (inbox / "bad.docx").write_bytes(b"no zip")
    (inbox / "left.rtf").write_text("x")
    (inbox / "~$lock.md").write_text("x")
    gate = w.Gate(inbox, inbox / ".landing")
    assert gate.look() == [] and len(gate.look()) == 2
    w.watch(spark, inbox, folder, tmp_path / "out", tmp_path / "ck", interval=None).awaitTermination(120)
    assert (tmp_path / "out" / "good-one" / "coverage.csv").exists()
    assert (inbox / "done" / "good one.md").exists()
    assert (inbox / "failed" / "bad.docx").exists() and "bad.docx" in (inbox / "failed" / "bad.docx.error.txt").read_text()
    assert (inbox / "left.rtf").exists() and (inbox / "~$lock.md").exists()


def test_watch_needs_a_library(spark, tmp_path):
    (tmp_path / "bare").mkdir()
    with pytest.raises(w.EmptyLibrary):
        w.watch(spark, tmp_path, tmp_path / "bare", tmp_path / "out", tmp_path / "ck")


def test_made_files():
    from tendrel.plans import fixtures as f

    for name, data in f.files().items():
        try:
            got = readers.read_bytes(name, data), None
        except readers.Unreadable as e:
            assert name in str(e)
            got = None, e.kind
        assert got == f.FILES_READ[name], name


@pytest.mark.parametrize("name", ["a.docx", "a.xlsx", "flate.pdf", "plain.pdf"])
def test_damaged_files_fail_in_one_way(name):
    """Bytes changed, cut out and doubled anywhere: text or Unreadable, nothing else."""
    import random

    from tendrel.plans import fixtures as f

    r, good = random.Random(name), f.files()[name]
    for _ in range(2500):
        data = bytearray(good)
        for _ in range(r.randrange(1, 6)):
            at = r.randrange(len(data))
            kind = r.randrange(3)
            if kind == 0:
                data[at] = r.randrange(256)
            elif kind == 1:
                del data[at : at + r.randrange(1, 30)]
            else:
                data[at:at] = data[at : at + r.randrange(1, 30)]
        try:
            assert isinstance(readers.read_bytes(name, bytes(data)), str)
        except readers.Unreadable as e:
            assert e.kind and name in str(e)


def test_library_that_fails_to_load_keeps_the_last_good_one(spark, folder, monkeypatch):
    library = w.Library(spark, folder)
    before = library.current()
    (folder / "good.md").write_text("# New\n" + PROSE)

    def fails(*_):
        raise RuntimeError("half copied")

    monkeypatch.setattr(readers, "load_corpus", fails)
    assert library.current() is before
    monkeypatch.undo()
    assert {r["heading"] for r in library.current().collect()} == {"New", ""}
