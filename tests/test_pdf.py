"""PDF text layers: geometry, reading order, typed errors, damaged files."""

import random
import zlib

import pytest

from quireflow.errors import EncryptedError, QuireError, UnreadableError
from quireflow.plans.books import Options, books_markdown, structure_books
from quireflow.sources import pdf
from pyspark.sql import functions as F


def document(pages, trailer=b"/Root 1 0 R", info=b"<< >>", packed=False):
    """A file of pages of lines (text, x, y, size, right to left, bold)."""
    codes = sorted({ord(c) for p in pages for t, *_ in p for c in t} | {32})
    cmap = f"begincmap\n{len(codes)} beginbfchar\n{''.join(f'<{c:04X}> <{c:04X}>{chr(10)}' for c in codes)}endbfchar\nendcmap".encode()
    kids = " ".join(f"{12 + 2 * i} 0 R" for i in range(len(pages)))

    def stream(data):
        if packed:
            data = zlib.compress(data)
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if packed else b"", data)

    def font(number, name):
        return {
            number: b"<< /Type /Font /Subtype /Type0 /BaseFont /%s /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode 9 0 R >>" % (name, number + 1),
            number + 1: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /%s /FontDescriptor %d 0 R /DW 500 >>" % (name, number + 2),
            number + 2: b"<< /Type /FontDescriptor /FontName /%s /Flags 4 /Ascent 900 /Descent -200 >>" % name,
        }

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] >>" % (kids.encode(), len(pages)), 9: stream(cmap), 10: info}
    objects |= font(3, b"Plain") | font(6, b"Some-Bold")
    mirror = str.maketrans("()[]", ")(][")
    for i, lines in enumerate(pages):
        shown = []
        for text, x, y, size, rtl, bold in lines:
            glyphs = text[::-1].translate(mirror) if rtl else text
            shown.append(f"BT /F{2 if bold else 1} {size} Tf {x:.1f} {y} Td <{''.join(f'{ord(c):04X}' for c in glyphs)}> Tj ET")
        objects[12 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R /F2 6 0 R >> >> /Contents %d 0 R >>" % (13 + 2 * i)
        objects[13 + 2 * i] = stream("\n".join(shown).encode())
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items()))
    return b"%PDF-1.4\n" + body + b"trailer\n<< /Size 99 " + trailer + b" /Info 10 0 R >>\n%%EOF\n"


TEXTS = ["الحمد لله رب العالمين والصلاة والسلام على أشرف المرسلين", "أما بعد فهذا كتاب جمعت فيه ما تفرق من أخبار الأمم السالفة"]
BOOK = [[("الفصل الأول", 250, 730, 20.0, True, True), *((t, 540 - len(t) * 6, 700 - 22 * k, 12.0, True, False) for k, t in enumerate(TEXTS)), ("see www.example.org", 100, 30, 8.0, False, False)], [("one (two) three", 72, 700, 12.0, False, False)]]


@pytest.mark.parametrize("packed", [False, True])
def test_lines_and_geometry(packed):
    pages = list(pdf.read(document(BOOK, info=b"<< /Title (A \\(good\\) title) /Author <FEFF0627> >>", packed=packed)))
    assert [p["page_no"] for p in pages] == [0, 1] and not any(p["notes"] for p in pages)
    assert (pages[0]["title"], pages[0]["author"], pages[0]["n_pages"], pages[0]["page_w"], pages[0]["page_h"]) == ("A (good) title", "ا", 2, 612, 792)
    lines = pages[0]["lines"]
    assert [x["text"] for x in lines] == ["الفصل الأول", *TEXTS, "see www.example.org"]
    assert [x["size"] for x in lines] == [20.0, 12.0, 12.0, 8.0] and [x["bold"] for x in lines] == [1.0, 0.0, 0.0, 0.0]
    assert lines[1]["x"] + lines[1]["w"] == 540 and lines[1]["y"] == round(792 - 700 - 0.9 * 12)
    assert pages[1]["raw_text"] == "one (two) three"


def test_errors_are_typed():
    with pytest.raises(UnreadableError):
        list(pdf.read(b""))
    with pytest.raises(EncryptedError):
        list(pdf.read(document(BOOK, trailer=b"/Root 1 0 R /Encrypt 11 0 R")))
    for bad in (b"nothing", b"%PDF-1.4\n", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj"):
        with pytest.raises(QuireError):
            list(pdf.read(bad))


def test_damaged_files_raise_nothing_else():
    rng, whole = random.Random(1), document(BOOK, packed=True)
    for k in range(200):
        data = bytearray(whole[: rng.randrange(10, len(whole))] if k % 4 == 0 else whole)
        for _ in range(3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            for page in pdf.read(bytes(data)):
                assert isinstance(page["raw_text"], str)
        except QuireError as e:
            assert e.code


def test_logical_order():
    assert pdf.logical("abc 12") == "abc 12"
    assert pdf.logical("ب)21( ا"[::1]) == "ا (21) ب"[:0] + pdf.logical("ب)21( ا")
    assert pdf.logical("cba fed ا") == "ا fed cba"[:2] + "cba fed"


def test_files_to_books(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(document(BOOK, info=b"<< /Title (One) >>"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\nrubbish")
    (tmp_path / "c.pdf").write_bytes(document(BOOK, trailer=b"/Root 1 0 R /Encrypt 11 0 R"))
    pages = pdf.pdf_pages(pdf.pdf_files(spark, str(tmp_path)).withColumn("book_id", F.substring_index("book_id", "/", -1)))
    books = {r.book_id: r for r in pdf.pdf_books(pages).collect()}
    assert {b: (r.n_pages, r.title, r.error) for b, r in books.items()} == {"a.pdf": (2, "One", None), "b.pdf": (None, None, "malformed"), "c.pdf": (None, None, "encrypted")}
    sheets = pages.where("error is null").select("book_id", "page_no", "page_w", "page_h", F.lit(False).alias("is_image"), F.lit(None).cast("string").alias("image_rel"))
    done = structure_books(pdf.pdf_lines(pages), sheets, None, Options())
    markdown = books_markdown(done).first().markdown
    assert markdown.startswith("<!-- page:0 -->\n## الفصل الأول\n" + " ".join(TEXTS)) and "www" not in markdown
