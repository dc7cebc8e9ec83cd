"""Whole-page structuring, merging, mining, chapters, e-books, stages and streams."""

import random
import zipfile
from difflib import SequenceMatcher
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quireflow.errors import InvalidBookError, MissingLibraryError
from quireflow.operators import chapters as C
from quireflow.operators import gate as G
from quireflow.operators import lines as L
from quireflow.operators import markdown as M
from quireflow.operators import merge, repeated, report
from quireflow.plans import books
from quireflow.sinks import epub
from quireflow.sources import pdf, readers
from quireflow.stages import kept_stage
from quireflow.streaming.books import markdown_stream, process_available

LINE = "book_id string, page_no int, line_no int, text string, x int, y int, w int, h int, size double, bold double"


def line(text, y, size=12.0, indent=0, center=False, bold=0.0):
    w, h = max(1, round(len(text) * size / 2)), round(size)
    return text, round((612 - w) / 2) if center else 540 - indent - w, y, w, h, float(size), bold


def book(spark, pages):
    rows = [("b", p, i, *x) for p, lines in enumerate(pages) for i, x in enumerate(lines)]
    lines = spark.createDataFrame(rows, LINE)
    frame = spark.createDataFrame([("b", p, 612, 792, False, None) for p in range(len(pages))], "book_id string, page_no int, page_w int, page_h int, is_image boolean, image_rel string")
    s = books.structure_books(lines, frame, spark.createDataFrame([("b", 12.0)], "book_id string, body_size double"))
    return books.books_markdown(s).first().markdown.split("\n"), {r.page_no: r for r in s.report.collect()}


def test_page_with_notes_lists_and_merge(spark):
    first = [
        line("الفصل الثاني", 40, 20, center=True),
        line("هذا سطر أول في الصفحة وفيه إحالة (١) إلى مصدر قديم", 90),
        line("وهذا سطر ثان يتم به الكلام.", 112),
        line("1. بند أول في القائمة المرقمة هنا", 134),
        line("2. بند ثان في القائمة المرقمة هنا", 156),
        line("ثم يعود الكلام متصلا إلى آخر الصفحة دون وقف", 178),
        line("(١) حاشية مطبوعة بخط صغير أسفل الصفحة", 700, 8),
        line("تتمة الحاشية في سطر ثان أسفل الصفحة", 712, 8),
        line("٥", 750, 8, center=True),
    ]
    second = [line("فيتصل بما قبله في الصفحة التالية كما ترى هنا.", 90)]
    md, rep = book(spark, [first, second])
    assert md == [
        "<!-- page:0 -->", "## الفصل الثاني", "هذا سطر أول في الصفحة وفيه إحالة [^p1-1] إلى مصدر قديم وهذا سطر ثان يتم به الكلام.", "1. بند أول في القائمة المرقمة هنا", "1. بند ثان في القائمة المرقمة هنا",
        "ثم يعود الكلام متصلا إلى آخر الصفحة دون وقف", "[^p1-1]: حاشية مطبوعة بخط صغير أسفل الصفحة تتمة الحاشية في سطر ثان أسفل الصفحة", "<!-- page:1 -->", "فيتصل بما قبله في الصفحة التالية كما ترى هنا.",
    ]
    assert rep[0].dropped_chars == 1 and rep[1].coverage == 1.0


def test_boundary_and_bold_heading(spark):
    pages = [[line("تمهيد للكتاب", 40, bold=1.0, center=True), line("كلام لم ينته عند آخر هذه الصفحة الأولى", 90)], [line("فأكمله في التي تليها.", 90)], [line("صفحة ثالثة مستقلة بنفسها عما قبلها.", 90)]]
    md, _ = book(spark, pages)
    assert md == ["<!-- page:0 -->", "## تمهيد للكتاب", "كلام لم ينته عند آخر هذه الصفحة الأولى فأكمله في التي تليها.", "<!-- page:1 -->", "<!-- page:2 -->", "صفحة ثالثة مستقلة بنفسها عما قبلها."]


def test_verses(spark):
    lines = ["تذكرت أيام الصبا والزمان", "وكنا على عهد الهوى في أمان", "فلما انقضى عنا نعيم المكان", "بكينا على ما فات طول الأوان"]
    md, _ = book(spark, [[line(t, 90 + 22 * i) for i, t in enumerate(lines)]])
    assert md == ["<!-- page:0 -->", ":::verse", *lines, ":::"]


def test_merge_equals_recursion(spark):
    rng = random.Random(3)
    rows = [(f"b{b}", p, rng.random() < 0.6 and p > 0, rng.random() < 0.7) for b in range(40) for p in range(25)]
    got = {(r.book_id, r.page_no): r.merges for r in merge.merged_pages(spark.createDataFrame(rows, "book_id string, page_no int, joins boolean, single boolean")).collect()}
    state = {}
    for b, p, joins, single in rows:
        before = state.get((b, p - 1))
        state[b, p] = (joins and not (before and before[0] and before[1]), single)
    assert got == {k: v[0] for k, v in state.items()}


def test_mining_equals_page_by_page(spark):
    rng = random.Random(4)
    heads = ["Annual Report 2020", "Annua1 Report 2O20", "chapter on methods", "site www example"]
    pages = [[rng.choice(heads), f"own line number {p} of this page", "body " * 15, f"other {rng.randrange(10**6)}", rng.choice(heads)] for p in range(30)]
    df = spark.createDataFrame([("b", p, i, t) for p, ls in enumerate(pages) for i, t in enumerate(ls)], "book_id string, page_no int, line_no int, text string")
    counts, first = {}, {}
    for ls in pages:
        seen = set()
        for t in ls[:2] + ls[-2:]:
            key = "".join(c for c in t.lower() if c.isalnum())
            if len(t) > 60 or len(key) < 4:
                continue
            key = next((k for k in counts if abs(len(k) - len(key)) <= 4 and SequenceMatcher(None, k, key).ratio() >= 0.85), key)
            counts.setdefault(key, 0)
            first.setdefault(key, t)
            if key not in seen:
                seen.add(key)
                counts[key] += 1
    want = [(k, first[k], n) for k, n in counts.items() if n >= 12]
    got = [(r.key, r.representative, r.pages) for r in repeated.repeated_lines(df).orderBy("nth").collect()]
    assert got == want and got
    assert repeated.repeated_lines(df.where("page_no < 4")).count() == 0


def test_text_layer_cases(spark):
    good, bad = "كلمة صحيحة " * 30, "ل شيء " * 30
    cases = {"a": [bad] * 3 + [good], "b": [good] * 3 + [bad], "c": [bad] * 3 + ["نص قصير لا يقاس هنا"], "d": [bad] * 2, "e": [good] * 3 + ["\ue001" * 30]}
    df = spark.createDataFrame([(b, i, t) for b, ts in cases.items() for i, t in enumerate(ts)], "book_id string, page_no int, raw_text string")
    got = {(r.book_id, r.page_no): (r.verdict, r.allowed) for r in G.text_layer_verdict(df).collect()}
    assert {p for (b, p), v in got.items() if b == "a" and v[1]} == set() and got["a", 0][0] == "rejected"
    assert [got["b", p][1] for p in range(4)] == [True, True, True, False] and got["b", 0][0] == "accepted"
    assert not got["c", 3][1] and got["d", 0] == ("small-sample", False) and [got["e", p][1] for p in range(4)] == [True] * 3 + [False]
    assert all(r.allowed for r in G.text_layer_verdict(df, "always").collect())


def test_chapters_and_books(spark):
    md = "<!-- page:0 -->\n# One\n# more\ntext [^n]\n## sub\n<!-- page:1 -->\n# Two\n- a\n- b\n[^n]: the note\nlost [^x] & <b>\n"
    docs = spark.createDataFrame([("b", md), ("e", "only text")], "book_id string, markdown string")
    elements = C.relocated(C.chaptered(M.parse_books(docs))).cache()
    got = {(r.book_id, r.chapter_no): (r.title, r.n_elements) for r in C.chapters(elements).collect()}
    assert got == {("b", 0): ("One more", 4), ("b", 1): ("Two", 4), ("e", 0): ("فصل 1", 1)}
    made = [epub.epubs(elements, C.volumes(C.chapters(elements), 1), elements.select("book_id").distinct().selectExpr("book_id", "'T' title", "'A' author", "'en' language")).orderBy("book_id").collect() for _ in range(2)]
    assert made[0] == made[1] and len(made[0]) == 2
    z = zipfile.ZipFile(BytesIO(made[0][0].epub))
    assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
    chapter = z.read("OEBPS/text/chap_001.xhtml").decode()
    assert 'class="noteref"' in chapter and "the note" in chapter
    assert "[^x] &amp; &lt;b&gt;" in z.read("OEBPS/text/chap_002.xhtml").decode()
    with pytest.raises(InvalidBookError):
        epub.validate(bytes(made[0][0].epub)[:-40])


def test_front_matter(spark):
    df = spark.createDataFrame([("---\nTitle: 'A: b'\nx\nauthor: c\n---\nbody\n---",), ("---\ntitle: a\nbody",), ("plain",)], "markdown string")
    got = [(dict(r.meta), r.body) for r in M.front_matter(df).collect()]
    assert got == [({"title": "A: b", "author": "c"}, "body\n---"), ({}, "---\ntitle: a\nbody"), ({}, "plain")]


def test_table_function(spark):
    spark.udtf.register("parse_markdown", M.ParseMarkdown)
    assert [r.kind for r in spark.sql("SELECT * FROM parse_markdown('# a\n- b')").collect()] == ["h1", "ul"]


def test_report_warnings(spark):
    rows = [("b", p, 100, 0, 50 if p < 12 else 100, 0.5 if p < 12 else 1.0) for p in range(20)]
    w = report.warnings(spark.createDataFrame(rows, "book_id string, page_no int, source_chars long, dropped_chars long, emitted_chars long, coverage double")).orderBy("nth").collect()
    assert [x.kind for x in w] == ["book", *["page"] * 10, "more"] and w[-1].percent == 2 and w[0].percent == 70


def test_readers_stages_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("\ufeff# A\ntext", encoding="utf-8")
    (tmp_path / "in" / "x.pdf").write_bytes(b"no pdf")
    assert readers.markdown_files(spark, str(tmp_path / "in")).first().markdown == "# A\ntext"
    assert pdf.pdf_pages(pdf.pdf_files(spark, str(tmp_path / "in"))).first().error == "malformed"
    with pytest.raises(MissingLibraryError):
        readers.decoded(spark.range(1), lambda x: x, "id long", "no_such_library")
    page = '{"page_no":2,"size":[10,20],"lines":[{"words":[{"text":"a","conf":90,"bbox":[0,0,1,1]},{"text":" ","conf":-1,"bbox":[0,0,1,1]}],"bbox":[1,2,3,4]}]}'
    r = readers.ocr_pages(spark.createDataFrame([("b", page)], "book_id string, json string")).first()
    assert (r.page_no, r.page_h, r.text, r.x, r.h, r.size, r.conf) == (2, 20, "a", 1, 4, 0.0, 90.0)
    pages = spark.createDataFrame([("b", 0), ("b", 1)], "book_id string, page_no int")
    calls = []

    def compute(todo):
        calls.append(todo.count())
        return todo.withColumn("v", F.lit(1))

    for n in (1, 2, 2):
        assert kept_stage(str(tmp_path / "st"), "s", {"a": 1}, pages.where(f"page_no < {n}"), compute).count() == n
    assert calls == [1, 1, 0]
    out = str(tmp_path / "out")
    for _ in range(2):
        process_available(markdown_stream(spark, str(tmp_path / "in")), M.parse_books, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 2


@pytest.mark.parametrize("few", [0, 10**6])
def test_page_numbers(spark, monkeypatch, few):
    """By window or by range, ranks are those of sorting each book."""
    monkeypatch.setattr(L, "FEW_PAGES", few)
    rng = random.Random(3)
    rows = [("big", x) for x in rng.sample(range(10**6), 700)] + [("b", 5), ("b", -1), ("b", None), (None, 3), (None, 1), ("one", 9)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(s, i, f"t{i}\nu") for s, i in rows], "source string, doc_id long, text string")
    expect = {}
    for s, i in sorted(rows, key=lambda r: (str(r[0]), -(10**9) if r[1] is None else r[1])):
        expect[s, i] = sum(1 for a, _ in expect if a == s)
    assert {(r.book_id, r.at): r.page_no for r in L.page_numbers(df).collect()} == expect
    pages = L.document_pages(df).collect()
    assert {(r.book_id, r.doc_id): (r.page_no, r.text) for r in pages} == {k: (n, f"t{k[1]}\nu") for k, n in expect.items()} and len(pages) == len(rows)
    assert L.document_lines(df).count() == 2 * len(rows) and L.page_numbers(df.limit(0)).count() == 0
