"""Small made inputs with known results: files of every format, and texts at the edges of the rules."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.functions import text as T
from tendrel.operators import extract
from tendrel.sources import readers

PROSE = "The Supplier keeps a staffed service desk every day of the year for all users."


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _para(*runs: str) -> str:
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def docx() -> bytes:
    """Runs split inside a word, a two-paragraph cell, and a row and a cell in content controls."""
    cell = lambda *t: "<w:tc>" + "".join(map(_para, t)) + "</w:tc>"
    held = lambda x: f"<w:sdt><w:sdtContent>{x}</w:sdtContent></w:sdt>"
    rows = f"<w:tr>{cell('Ref')}{cell('Clause')}</w:tr>" + held(f"<w:tr>{cell('4.1')}{held(cell('The Supplier shall', 'hold cover.'))}</w:tr>") + f"<w:tr>{cell('')}{cell('')}</w:tr>"
    return zipped({"word/document.xml": f'<w:document xmlns:w="http://x/w"><w:body>{_para("Split o", "ver runs")}{_para("")}<w:tbl>{rows}</w:tbl></w:body></w:document>'})


def xlsx() -> bytes:
    shared = "<sst><si><t>Ref</t></si><si><t>Ask</t></si><si><r><t>The Supplier </t></r><r><t>must act.</t></r></si></sst>"
    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row/><row><c><v>12</v></c><c/><c t="s"><v>2</v></c><c t="inlineStr"><is><t>inline</t></is></c><c t="s"><v>99</v></c></row></sheetData></worksheet>'
    return zipped({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": "<worksheet><row><c><v>7</v></c></row></worksheet>"})


def pdf(content: bytes, entries: bytes = b"/Filter /FlateDecode", body: bytes | None = None, trailer: bytes = b"<< /Size 2 >>") -> bytes:
    body = zlib.compress(content) if body is None else body
    return b"%PDF-1.4\n1 0 obj\n<< " + entries + b" /Length %d >>\nstream\n" % len(body) + body + b"\nendstream\nendobj\ntrailer\n" + trailer + b"\n%%EOF"


def shown(*lines: bytes) -> bytes:
    return b"BT " + b" ".join(b"1 0 Td (%s) Tj" % x for x in lines) + b" ET"


def files() -> dict[str, bytes]:
    line, wide = PROSE.encode(), PROSE.encode("utf-16-be").hex().encode()
    return {
        "a.txt": b"\xef\xbb\xbfone\xfftwo",
        "a.MD": b"# Head\r\nbody",
        "a.docx": docx(),
        "a.xlsx": xlsx(),
        "flate.pdf": pdf(shown(line, rb"nested (brackets \) and \\ and \101) kept")),
        "bare deflate.pdf": pdf(b"", body=zlib.compress(shown(line))[2:-4]),
        "plain.pdf": pdf(b"", b"", shown(line)),
        "hex filter.pdf": pdf(b"", b"/Filter [/ASCIIHexDecode]", shown(line).hex().encode() + b">"),
        "hex string.pdf": pdf(b"BT << /X (no) /Y << /Z (no) >> >> <" + wide + b"> Tj ET"),
        "array.pdf": pdf(b"BT [(The Supp) -20 (lier keeps a staffed) 30 ( service desk)] TJ T* (every day) ' ET"),
        "octal.pdf": pdf(shown(line + rb" caf\351 \(\53\) line\
joined")),
        "image.pdf": pdf(b"BI /W 1 ID (noise\x00 EI " + shown(line)),
        "word encrypt.pdf": pdf(shown(line + b" /Encrypt is a word here")),
        "locked.pdf": pdf(shown(line), trailer=b"<< /Size 2 /Encrypt 5 0 R >>"),
        "scan.pdf": pdf(b"q 1 0 0 1 0 0 cm /Im Do Q"),
        "signs.pdf": pdf(shown(b"#$%&@!*+=" * 12)),
        "digits.pdf": pdf(shown(b"12 " * 40)),
        "not.pdf": b"no header",
        "old.docx": b"\xd0\xcf\x11\xe0" + b"0" * 50,
        "zero.docx": b"",
        "open.docx": zipped({"word/document.xml": "<w><open>"}),
        "other.docx": zipped({"other.xml": "<a/>"}),
        "types.docx": zipped({"word/document.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]><x/>"}),
        "coding.docx": zipped({"word/document.xml": "<?xml version='1.0' encoding='no-such-code'?><x/>"}),
        "none.xlsx": zipped({"xl/x.xml": "<a/>"}),
        "a.rtf": b"x",
    }


def read_all(spark: SparkSession) -> DataFrame:
    """(name, text, error_kind) of every made file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, data in zip(frame["name"], frame["data"]):
                try:
                    out.append((name, readers.read_bytes(name, bytes(data)), None))
                except readers.Unreadable as e:
                    out.append((name, None, e.kind))
            yield pd.DataFrame(out, columns=["name", "text", "error_kind"])

    return spark.createDataFrame([(n, bytearray(d)) for n, d in files().items()], "name string, data binary").mapInPandas(run, "name string, text string, error_kind string")


#: What each file must come out as, worked out by hand from what it holds.
FILES_READ = {
    "a.txt": ("one�two", None),
    "a.MD": ("# Head\r\nbody", None),
    "a.docx": ("Split over runs\nRef | Clause\n4.1 | The Supplier shall hold cover.", None),
    "a.xlsx": ("Ref | Ask\n12 | The Supplier must act. | inline\n7", None),
    "flate.pdf": (PROSE + "\nnested (brackets ) and \\ and A) kept", None),
    "bare deflate.pdf": (PROSE, None),
    "plain.pdf": (PROSE, None),
    "hex filter.pdf": (PROSE, None),
    "hex string.pdf": (PROSE, None),
    "array.pdf": ("The Supplier keeps a staffed service desk\nevery day", None),
    "octal.pdf": (PROSE + " café (+) linejoined", None),
    "image.pdf": (PROSE, None),
    "word encrypt.pdf": (PROSE + " /Encrypt is a word here", None),
    "locked.pdf": (None, "encrypted"),
    "scan.pdf": (None, "no text"),
    "signs.pdf": (None, "garbled"),
    "digits.pdf": (None, "garbled"),
    "not.pdf": (None, "not pdf"),
    "old.docx": (None, "bad zip"),
    "zero.docx": (None, "empty"),
    "open.docx": (None, "damaged"),
    "other.docx": (None, "not word"),
    "types.docx": (None, "damaged"),
    "coding.docx": (None, "unreadable"),
    "none.xlsx": (None, "no sheets"),
    "a.rtf": (None, "unsupported"),
}

#: (line, kind, obligation): an obligation is looked for behind the reference, never in it.
OBLIGATIONS = (
    ("MUST-1 The portal may offer a second language.", "clause", False),
    ("MUST-2 The portal must offer a second language.", "clause", True),
    ("4.1 Bids are required to name a contact person.", "clause", True),
    ("The Supplier is required to keep a register of assets.", "clause", True),
    ("Evening support is preferred by the school offices.", "clause", False),
    ("MUST-3. Describe how the desk is staffed at night.", "question", False),
)
#: (text, readable share, garbled): no-break spaces are readable, combining marks and digits are not.
SHARES = (
    ("letters and no-break blanks are readable signs here", 1.0, False),
    ("é" * 30, 0.5, True),
    ("1234567890" * 5, 0.0, True),
    ("too short to judge", 1.0, True),
    ("a1" * 10 + "b" * 20, 0.75, False),
)
#: (text, words wanted, sentences): words are whole, also with letters beyond ASCII.
SENTENCES = (("La réunion a lieu lundi. The union meets on Monday. Nobody attends.", ["union", "monday", "meets"], "The union meets on Monday."), ("Une réunion du union. Deux union réunion.", ["union", "réunion"], "Une réunion du union. / Deux union réunion."))


def rules_at_edges(spark: SparkSession) -> DataFrame:
    """(rule, input, result) of the rules on the rows above."""
    lines = spark.createDataFrame([(i, 1, line) for i, (line, *_) in enumerate(OBLIGATIONS)], "doc_id long, line_no int, line string")
    found = extract.extract(lines).join(lines.select("doc_id", "line"), "doc_id").select(F.lit("obligation").alias("rule"), F.col("line").alias("input"), F.concat_ws(" ", "kind", F.col("binding").cast("string")).alias("result"))
    texts = spark.createDataFrame([(t,) for t, *_ in SHARES], "text string")
    share = texts.select(F.lit("readable").alias("rule"), F.col("text").alias("input"), F.concat_ws(" ", F.format_number(T.readable_share(F.col("text")), 3), T.looks_garbled(F.col("text")).cast("string")).alias("result"))
    asked = spark.createDataFrame([(t, w) for t, w, _ in SENTENCES], "text string, wanted array<string>")
    best = asked.select(F.lit("sentences").alias("rule"), F.col("text").alias("input"), F.array_join(T.key_sentences(F.col("text"), F.col("wanted")), " / ").alias("result"))
    return found.unionByName(share).unionByName(best)


def edges_expected() -> list[tuple[str, str, str]]:
    word = {True: " true", False: " false"}
    return (
        [("obligation", line, kind + word[must]) for line, kind, must in OBLIGATIONS]
        + [("readable", t, f"{share:.3f}{word[garbled]}") for t, share, garbled in SHARES]
        + [("sentences", t, want) for t, _, want in SENTENCES]
    )
