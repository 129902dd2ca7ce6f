"""Text of office documents as Markdown: DOCX, PPTX, XLSX, the open formats, EPUB, RTF and CSV.

Tabs, line breaks, cells and paragraphs stay apart from what is beside them: a word boundary that the page shows is one in
the text, since an identifier is only found where it ends. What a reader of the document can bring up is read: notes,
headers, footers, comments, text boxes. What only its editor keeps (deletions, field codes, phonetic hints) is not.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import sys
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from .errors import Unsupported

Element = ElementTree.Element
#: Bytes that a document's parts may unpack to, and cells of a spreadsheet.
LARGEST, MOST_CELLS = 1 << 30, 5_000_000

csv.field_size_limit(sys.maxsize)


def markdown_table(rows: list[list[str]]) -> str:
    """Rows as a Markdown table whose head is the first; short rows are filled up."""
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(re.sub(r"[\r\n]+", " ", x).replace("|", "\\|") for x in r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]) + "\n"


def spaced(text: str, others: str = "\t\r\n") -> str:
    """Runs of spaces and `others` as one space; most texts have none, which is seen without a pattern."""
    return re.sub(f"[ {others}]+", " ", text) if "  " in text or any(c in text for c in others) else text


def decoded_text(content: bytes) -> str:
    """By its byte order mark, UTF-16 also by its zeros; else UTF-8, what is none shown as U+FFFD."""
    for mark, codec in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if content.startswith(mark):
            return content[len(mark) :].decode(codec, "replace")
    head = content[:1000]
    for zeros, codec in ((head[1::2], "utf-16-le"), (head[::2], "utf-16-be")):
        if len(head) >= 4 and zeros.count(0) > 0.9 * len(zeros):
            return content.decode(codec, "replace")
    return content.decode("utf-8", "replace")


def from_csv(content: bytes) -> str:
    """A Markdown table; parted by semicolons or tabs where the first line has no comma."""
    text = decoded_text(content)
    first = text.partition("\n")[0]
    mark = next((m for m in ",;\t" if m in first), ",")
    return markdown_table(list(csv.reader(io.StringIO(text, newline=""), delimiter=mark)))


# XML ----------------------------------------------------------------------------------------------------------------


def name_of(node: Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def value_of(node: Element, name: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), None)


class Parts:
    """The parts of a zipped document."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        if sum(i.file_size for i in self.zip.infolist()) > LARGEST:
            raise ValueError("the document unpacks to too much")
        number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
        self.names = sorted(self.zip.namelist(), key=number)

    def read(self, name: str) -> bytes:
        return self.zip.read(name)

    def xml(self, name: str) -> Element:
        return ElementTree.fromstring(self.read(name))  # noqa: S314

    def like(self, pattern: str) -> list[str]:
        return [n for n in self.names if re.fullmatch(pattern, n)]

    def related(self, name: str) -> dict[str, tuple[str, str]]:
        """Of a part: id to (kind, part)."""
        folder, file = posixpath.split(name)
        at = f"{folder}/_rels/{file}.rels"
        if at not in self.names:
            return {}
        place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {r.get("Id", ""): (r.get("Type", "").rpartition("/")[2], place(r.get("Target", ""))) for r in self.xml(at) if r.get("TargetMode") != "External"}

    def listed(self, name: str, node: str, pattern: str) -> list[str]:
        """Parts in the order in which `node` elements of a part name them; then others of the pattern."""
        there = self.like(pattern)
        order = []
        if name in self.names:
            ids = self.related(name)
            for x in self.xml(name).iter():
                if name_of(x) == node and (own := ids.get(next((v for k, v in x.attrib.items() if k.endswith("}id")), ""))):
                    order.append(own[1])
        return [n for n in dict.fromkeys(order) if n in there] + [n for n in there if n not in order]


#: Elements whose text a reader does not see.
WORD_HIDDEN = frozenset(("delText", "delInstrText", "instrText", "Fallback", "pPr", "rPr", "del", "moveFrom", "tblPr", "sectPr"))


def word_line(node: Element) -> str:
    """A paragraph's text, of what it holds but other paragraphs."""
    out = []
    for x in node:
        kind = name_of(x)
        if kind == "t":
            out.append(x.text or "")
        elif kind in ("tab", "ptab"):
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
        elif kind == "noBreakHyphen":
            out.append("-")
        elif kind == "sym":
            code = value_of(x, "char") or ""
            out.append(chr(int(code, 16)) if re.fullmatch("[0-9A-Fa-f]{1,5}", code) else "")
        elif kind not in WORD_HIDDEN and kind not in ("p", "tbl"):
            out.append(word_line(x))
    return "".join(out)


def word_blocks(node: Element) -> Iterator[str]:
    """Paragraphs, headings by their style, and tables, in order; the paragraphs of text boxes after theirs."""
    for b in node:
        kind = name_of(b)
        if kind == "p":
            style = next((value_of(x, "val") or "" for x in b.iter() if name_of(x) == "pStyle"), "")
            level = re.fullmatch(r"(?i)heading ?([1-6])|title", style)
            yield ("#" * int(level[1] or 1) + " " if level else "") + word_line(b)
            yield from word_boxes(b)
        elif kind == "tbl":
            yield markdown_table([[" ".join(filter(None, (t.strip("\n") for t in word_blocks(cell)))) for cell in cells_of(row, "tc")] for row in cells_of(b, "tr")])
        elif kind not in WORD_HIDDEN:
            yield from word_blocks(b)


def word_boxes(node: Element) -> Iterator[str]:
    for x in node:
        if name_of(x) == "txbxContent":
            yield from word_blocks(x)
        elif name_of(x) not in WORD_HIDDEN:
            yield from word_boxes(x)


def cells_of(node: Element, kind: str) -> Iterator[Element]:
    """Elements of a kind, within wrappers but not within one another."""
    for x in node:
        if name_of(x) == kind:
            yield x
        elif name_of(x) not in ("tbl", "tc", "p"):
            yield from cells_of(x, kind)


def from_docx(parts: Parts) -> Iterator[str]:
    yield from word_blocks(parts.xml("word/document.xml"))
    for n in parts.like(r"word/(?:footnotes|endnotes|comments|header\d*|footer\d*)\.xml"):
        yield from word_blocks(parts.xml(n))


def slide_line(node: Element) -> str:
    out = []
    for x in node.iter():
        if name_of(x) == "t":
            out.append(x.text or "")
        elif name_of(x) == "br":
            out.append("\n")
    return "".join(out)


def slide_blocks(node: Element) -> Iterator[str]:
    for b in node:
        kind = name_of(b)
        if kind == "p":
            yield slide_line(b)
        elif kind == "tbl":
            yield markdown_table([[" ".join(filter(None, slide_blocks(c))) for c in r if name_of(c) == "tc"] for r in b if name_of(r) == "tr"])
        elif kind != "Fallback":
            yield from slide_blocks(b)


def from_pptx(parts: Parts) -> Iterator[str]:
    for n in parts.listed("ppt/presentation.xml", "sldId", r"ppt/slides/slide\d+\.xml"):
        yield from slide_blocks(parts.xml(n))
        for kind, other in parts.related(n).values():
            if kind in ("notesSlide", "comments") and other in parts.names:
                yield from slide_blocks(parts.xml(other))
    for n in parts.like(r"ppt/comments/.*\.xml"):
        yield from (x.text or "" for x in parts.xml(n).iter() if name_of(x) == "text")


OPEN_BESIDE = frozenset(("note", "annotation"))


def open_line(node: Element) -> str:
    """A paragraph's text with white space as it is shown: runs are one space, `s`, `tab` and `line-break` what they say."""
    out: list[str] = []

    def add(text: str | None) -> None:
        own = spaced(text or "")
        out.append(own.lstrip(" ") if not out or out[-1][-1:] in (" ", "\n", "\t") else own)
        if not out[-1]:
            out.pop()

    def walk(x: Element) -> None:
        add(x.text)
        for y in x:
            kind = name_of(y)
            if kind == "s":
                n = value_of(y, "c") or "1"
                out.append(" " * (min(int(n), 10_000) if n.isdigit() else 1))
            elif kind == "tab":
                out.append("\t")
            elif kind == "line-break":
                out.append("\n")
            elif kind not in OPEN_BESIDE and kind not in ("p", "h", "table", "list"):
                walk(y)
            add(y.tail)

    walk(node)
    return "".join(out).rstrip(" ")


def open_blocks(node: Element) -> Iterator[str]:
    """Paragraphs, headings, tables; notes and comments after the paragraph that has them."""
    for b in node:
        kind = name_of(b)
        if kind in ("h", "p"):
            level = value_of(b, "outline-level") or "1"
            yield ("#" * min(6, int(level) if level.isdigit() else 1) + " " if kind == "h" else "") + open_line(b)
            for x in b.iter():
                if name_of(x) in ("note-body", "annotation", "text-box"):
                    yield from open_blocks(x)
        elif kind == "table":
            yield markdown_table(list(open_rows(b)))
        elif kind not in ("tracked-changes", "table-column"):
            yield from open_blocks(b)


def open_rows(table: Element) -> Iterator[list[str]]:
    held = 0
    for r in table.iter():
        if name_of(r) != "table-row":
            continue
        cells: list[str] = []
        for c in r:
            if name_of(c) not in ("table-cell", "covered-table-cell"):
                continue
            n = value_of(c, "number-columns-repeated") or "1"
            cells += [" ".join(filter(None, (t.strip("\n") for t in open_blocks(c))))] * min(int(n) if n.isdigit() else 1, 16_384)
        while cells and not cells[-1]:
            cells.pop()
        if cells:
            n = value_of(r, "number-rows-repeated") or "1"
            for _ in range(min(int(n) if n.isdigit() else 1, 1 << 20)):
                held += len(cells)
                if held > MOST_CELLS:
                    raise ValueError("the table is too large")
                yield cells


def from_open(parts: Parts) -> Iterator[str]:
    yield from open_blocks(parts.xml("content.xml"))
    if "styles.xml" in parts.names:
        for x in parts.xml("styles.xml").iter():
            if name_of(x) in ("header", "footer", "header-left", "footer-left", "header-first", "footer-first"):
                yield from open_blocks(x)


def sheet_text(node: Element) -> str:
    """The text of a shared or inline string: all its runs, without phonetic hints."""
    out = []
    for x in node:
        if name_of(x) == "t":
            out.append(x.text or "")
        elif name_of(x) not in ("rPh", "phoneticPr", "rPr"):
            out.append(sheet_text(x))
    return "".join(out)


def sheet_rows(sheet: Element, shared: list[str]) -> Iterator[list[str]]:
    held = 0
    for row in (r for r in sheet.iter() if name_of(r) == "row"):
        cells: list[str] = []
        for c in (c for c in row if name_of(c) == "c"):
            if at := re.match("[A-Z]+", c.get("r") or ""):  # empty cells may be left out
                column = 0
                for x in at[0]:
                    column = column * 26 + ord(x) - 64
                cells += [""] * (min(column, 16_384) - 1 - len(cells))
            kind, v = c.get("t"), next((x.text or "" for x in c if name_of(x) == "v"), "")
            if kind == "s":
                v = shared[int(v)] if v.isdigit() and int(v) < len(shared) else v
            elif kind == "inlineStr":
                v = "".join(sheet_text(x) for x in c if name_of(x) == "is")
            elif kind == "b":
                v = "TRUE" if v == "1" else "FALSE"
            cells.append(v)
        held += len(cells)
        if held > MOST_CELLS:
            raise ValueError("the table is too large")
        yield cells


def from_xlsx(parts: Parts) -> Iterator[str]:
    shared = [sheet_text(x) for x in parts.xml("xl/sharedStrings.xml") if name_of(x) == "si"] if "xl/sharedStrings.xml" in parts.names else []
    for n in parts.listed("xl/workbook.xml", "sheet", r"xl/worksheets/[^/]+\.xml"):
        yield markdown_table(list(sheet_rows(parts.xml(n), shared)))
    for n in parts.like(r"xl/(?:comments\d*|comments/[^/]+|threadedComments/[^/]+)\.xml"):
        yield from (sheet_text(x) or x.text or "" for x in parts.xml(n).iter() if name_of(x) == "text")


# Books --------------------------------------------------------------------------------------------------------------

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead title tr ul".split())
UNSEEN = frozenset(("script", "style", "template"))


class BookPage(HTMLParser):
    """Blocks of a page: headings, list items, paragraphs, rows with bars between cells. All its text is in one of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.text: list[str] = []
        self.mark, self.unseen, self.pre = "", 0, 0

    def flush(self, mark: str = "") -> None:
        text = "".join(self.text)
        if not self.pre:
            text = spaced(text.replace("\v", "\n"), "\t\r\f")
            text = (re.sub(r" ?\n ?", "\n", text) if "\n" in text else text).strip(" \n")
        if text.strip():
            self.blocks.append(self.mark + text.strip("\n"))
            self.mark = ""
        self.text = []
        self.mark = mark or self.mark

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in UNSEEN:
            self.unseen += 1
        elif tag == "br":
            self.text.append("\v")
        elif tag in ("td", "th"):
            if any(t.strip() for t in self.text):
                self.text.append(" | ")
        elif tag in BLOCKS:
            self.flush("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else "")
            self.pre += tag == "pre"

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag not in UNSEEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in UNSEEN:
            self.unseen = max(0, self.unseen - 1)
        elif tag in BLOCKS:
            self.flush()
            self.mark = ""
            self.pre = max(0, self.pre - (tag == "pre"))

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data if self.pre else spaced(data, "\t\r\n\f"))


def page_blocks(raw: bytes) -> list[str]:
    page = BookPage()
    page.feed(decoded_text(raw))
    page.close()
    page.flush()
    return page.blocks


def from_epub(parts: Parts) -> Iterator[str]:
    there = [n for n in parts.names if n.lower().endswith((".xhtml", ".html", ".htm"))]
    order: list[str] = []
    for n in parts.names:
        if not n.endswith(".opf"):
            continue
        package, folder = parts.xml(n), posixpath.dirname(n)
        items = {x.get("id"): posixpath.normpath(posixpath.join(folder, x.get("href", ""))) for x in package.iter() if name_of(x) == "item"}
        order += [items[x.get("idref")] for x in package.iter() if name_of(x) == "itemref" and x.get("idref") in items]
    for n in [n for n in dict.fromkeys(order) if n in parts.names] + [n for n in there if n not in order]:
        yield from page_blocks(parts.read(n))


ZIPPED: dict[str, Callable[[Parts], Iterator[str]]] = {"docx": from_docx, "pptx": from_pptx, "odt": from_open, "odp": from_open, "ods": from_open, "epub": from_epub, "excel": from_xlsx}


def from_office(content: bytes, format: str) -> str:
    """Markdown of a zipped format: its blocks, a blank line between."""
    if format not in ZIPPED:
        raise Unsupported(f"no extractor for {format}")
    return "\n\n".join(x for x in ZIPPED[format](Parts(content)) if x.strip())


# RTF ----------------------------------------------------------------------------------------------------------------

RTF = re.compile(rb"\\([a-zA-Z]{1,32})(-?[0-9]{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+|\\\Z")
#: Words that stand for characters; destinations that hold no text of the page.
RTF_CHARS = {b"tab": "\t", b"cell": "\t", b"nestcell": "\t", b"row": "\n", b"nestrow": "\n", b"par": "\n", b"line": "\n", b"sect": "\n", b"page": "\n", b"column": "\n", b"softline": "\n", b"emdash": "—", b"endash": "–", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"bullet": "•", b"emspace": " ", b"enspace": " ", b"qmspace": " "}
RTF_HIDDEN = frozenset((b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"fldinst", b"object", b"themedata", b"colorschememapping", b"datastore", b"listtable", b"listoverridetable", b"rsidtbl", b"generator", b"xmlnstbl", b"filetbl", b"revtbl", b"latentstyles", b"pgptbl", b"nonshppict", b"bkmkstart", b"bkmkend", b"deleted"))
#: Destinations after \* that hold text all the same.
RTF_SHOWN = frozenset((b"shpinst", b"shptxt", b"footnote", b"annotation", b"atnid", b"atnauthor", b"ud"))


def from_rtf(content: bytes) -> str:
    out: list[str] = []
    held = bytearray()  # bytes of the code page, which may take several for a character
    page, hidden, skip, left = "cp1252", False, 1, 0
    stack: list[tuple[bool, int]] = []
    high = 0
    starred = False

    def settle() -> None:
        if held:
            out.append(held.decode(page, "replace"))
            held.clear()

    at = 0
    while at < len(content):
        m = RTF.match(content, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        word, number, code, sign, brace, plain = m.groups()
        if brace == b"{":
            settle()
            stack.append((hidden, skip))
            left = 0
        elif brace == b"}":
            settle()
            hidden, skip = stack.pop() if stack else (False, 1)
            starred, left = False, 0
        elif word is not None:
            if word == b"bin":
                at += max(0, int(number or 0))
                continue
            if word == b"u" and number:
                settle()
                n = int(number) & 0xFFFF
                if not hidden:
                    if 0xD800 <= n < 0xDC00:
                        high = n
                    elif 0xDC00 <= n < 0xE000:
                        out.append(chr(0x10000 + ((high - 0xD800) << 10) + n - 0xDC00) if high else "�")
                        high = 0
                    else:
                        out.append(chr(n))
                left = skip
                continue
            left = 0
            if word == b"uc":
                skip = int(number or 1)
            elif word == b"ansicpg":
                try:
                    b"".decode(page := f"cp{int(number or 1252)}")
                except LookupError:
                    page = "cp1252"
            elif word in RTF_HIDDEN or (starred and word not in RTF_SHOWN):
                hidden = True
            elif not hidden and word in RTF_CHARS:
                settle()
                out.append(RTF_CHARS[word])
            elif not hidden and word in (b"footnote", b"header", b"footer", b"headerf", b"footerf", b"headerl", b"headerr", b"footerl", b"footerr", b"annotation", b"shptxt", b"fldrslt"):
                settle()
                out.append("" if word == b"fldrslt" else "\n")
            starred = False
        elif sign is not None:
            if sign == b"*":
                starred = True
            elif not hidden:
                settle()
                out.append({b"~": "\xa0", b"_": "-", b"-": "", b"\n": "\n", b"\r": "\n", b":": "", b"|": ""}.get(sign, sign.decode("latin-1")))
        elif code is not None or plain is not None:
            starred = False
            raw = bytes.fromhex(code.decode()) if code is not None else plain
            if left:
                cut = min(left, len(raw))
                raw, left = raw[cut:], left - cut
            if not hidden:
                held += raw
    settle()
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()
