"""Documents written into files of every kind that is read here, and SQL for what reading them must give."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape

#: SQL of a text on one line: runs of white space and controls as one space, none at the ends.
SPACE = r"[\x00-\x20\x7F-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{fffe}\x{ffff}]+"
LINE = f"trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g'))"
#: Its characters but the space, which is the most of them and needs no pattern.
ODD = re.compile("[\x00-\x1f\x7f-\xa0  -     　￾￿]")
FORMATS = ["docx", "pptx", "odt", "odp", "rtf", "epub", "excel", "ods"]
NL = "chr(10)"


def one_line(text: str | None) -> str:
    """LINE in Python."""
    return " ".join(filter(None, ODD.sub(" ", text or "").split(" ")))


def office_file(format: str, text: str, key: int) -> bytes:
    """The text with an address behind a tab, one behind a line break and one in a table's second cell."""
    t, a, b, c = escape(text, quote=False), *(f"{x}{key}@b.io" for x in "abc")
    if format == "rtf":
        units = lambda raw: "".join(f"\\u{int.from_bytes(raw[i : i + 2], 'little', signed=True)}?" for i in range(0, len(raw), 2))
        coded = re.sub(r"[\\{}]|[^\x00-\x7f]+", lambda m: units(m[0].encode("utf-16-le")) if m[0] > "\x7f" else "\\" + m[0], text)
        return f"{{\\rtf1\\ansi{{\\fonttbl{{\\f0 Foo;}}}}{{\\*\\generator no;}}{coded}\\tab {a}\\par x\\line {b}\\par\\trowd\\cellx100 y\\cell {c}\\cell\\row}}".encode()
    parts = {
        "docx": {"word/document.xml": f'<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>{t}</w:t><w:tab/><w:t>{a}</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t><w:br/><w:t>{b}</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'},
        "pptx": {"ppt/slides/slide1.xml": f'<p:sld xmlns:p="u" xmlns:a="v"><a:p><a:r><a:t>{t}&#9;{a}</a:t></a:r></a:p><a:p><a:r><a:t>x</a:t></a:r><a:br/><a:r><a:t>{b}</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:p><a:r><a:t>y</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:sld>'},
        "odt": {"content.xml": f'<o:d xmlns:o="u" xmlns:table="b" xmlns:text="t"><text:p>{t}<text:tab/>{a}</text:p><text:p>x<text:line-break/>{b}</text:p><table:table><table:table-row><table:table-cell><text:p>y</text:p></table:table-cell><table:table-cell><text:p>{c}</text:p></table:table-cell></table:table-row></table:table></o:d>'},
        "epub": {"p.opf": '<package><manifest><item id="1" href="z.xhtml"/><item id="2" href="a.xhtml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>', "z.xhtml": f"<html><body><div>{t} {a}</div><p>x<br/>{b}&nbsp;</p></body></html>", "a.xhtml": f"<table><tr><td>y</td><td>{c}</td></tr></table>"},
        "excel": {"xl/sharedStrings.xml": f'<sst xmlns="u"><si><t>{t}</t><rPh><t>no</t></rPh></si></sst>', "xl/worksheets/sheet1.xml": f'<worksheet xmlns="u"><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><r><t>{a[:1]}</t></r><r><t>{a[1:]}</t></r></is></c></row><row><c t="str"><v>x</v></c><c t="str"><v>{b}</v></c></row><row><c t="str"><v>y</v></c><c t="str"><v>{c}</v></c></row></sheetData></worksheet>'},
        "ods": {"content.xml": f'<o:d xmlns:o="u" xmlns:table="b" xmlns:text="t"><table:table>' + "".join(f"<table:table-row><table:table-cell><text:p>{p}</text:p></table:table-cell><table:table-cell><text:p>{q}</text:p></table:table-cell></table:table-row>" for p, q in ((t, a), ("x", b), ("y", c))) + "</table:table></o:d>"},
    }
    parts["odp"] = parts["odt"]
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for at, data in parts[format].items():
            z.writestr(at, data)
    return made.getvalue()


A, B, C = (f"'{x}' || doc_id || '@b.io'" for x in "abc")
HEAD = f"'| --- | --- |' || {NL}"
PARTED = f"trim(t || chr(9) || {A}, chr(9) || ' ')"
BLOCKS = f"{PARTED} || {NL} || {NL} || 'x' || {NL} || {B} || {NL} || {NL} || '| y | ' || {C} || ' |' || {NL} || {HEAD}"
TABLE = f"'| ' || replace(t, '|', '\\|') || ' | ' || {A} || ' |' || {NL} || {HEAD} || '| x | ' || {B} || ' |' || {NL} || '| y | ' || {C} || ' |' || {NL}"
#: SQL of each format's text from doc_id and t, the document on one line; a tab before an address stays where no word is before it.
TEXT = {
    "docx": BLOCKS.replace(PARTED, f"t || chr(9) || {A}"), "pptx": BLOCKS.replace(PARTED, f"t || chr(9) || {A}"), "odt": BLOCKS.replace(PARTED, f"t || chr(9) || {A}"), "odp": BLOCKS.replace(PARTED, f"t || chr(9) || {A}"),
    "rtf": f"{PARTED} || {NL} || 'x' || {NL} || {B} || {NL} || 'y' || chr(9) || {C}", "epub": f"trim(t || ' ' || {A}) || {NL} || {NL} || 'x' || {NL} || {B} || chr(160) || {NL} || {NL} || 'y | ' || {C}", "excel": TABLE, "ods": TABLE,
}
FORMAT_OF = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FORMATS)) + " END"
OFFICE_TEXTS = f"(SELECT doc_id, CASE doc_id % 8 {' '.join(f'WHEN {i} THEN {TEXT[f]}' for i, f in enumerate(FORMATS))} END AS text FROM (SELECT doc_id, {LINE} AS t FROM documents))"
PDF_TEXTS = f"(SELECT doc_id, {LINE} AS text FROM documents)"
