"""PDFs for tests and queries live in the package; here are files by hand."""


def classic(objects: list[bytes], trailer: bytes = b"/Root 1 0 R", broken: bool = False) -> bytes:
    """Objects 1.. with a cross-reference table; `broken`: its places are wrong."""
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out) + 7 * broken)
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + table + b"trailer << /Size %d %s >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, trailer, len(out))


def stream(data: bytes, head: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def one_page(content: bytes, font: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", page: bytes = b"", more: tuple[bytes, ...] = (), head: bytes = b"", broken: bool = False) -> bytes:
    """A page of 600 by 800 whose font is F."""
    return classic([
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800] >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >> %s >>" % page, stream(content, head), font, *more], broken=broken)
