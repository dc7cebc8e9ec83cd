"""Work folders, giant chapters, placeholders, own drop rules, the command line."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quireflow import cli
from quireflow.errors import OptionError
from quireflow.operators import chapters as C
from quireflow.operators import notes as N
from quireflow.plans import books
from quireflow.sources import readers
from quireflow.stages import WorkFolder

from test_pdf import BOOK, document


def test_work_folder(spark, tmp_path):
    root = str(tmp_path / "work")
    pages = spark.createDataFrame([("b", 0), ("b", 1)], "book_id string, page_no int")
    seen = []

    def compute(todo):
        seen.append(todo.count())
        return todo.withColumn("v", F.lit(1))

    work = WorkFolder(spark, root, "one")
    for n, settings in ((1, {"a": 1}), (2, {"a": 1}), (2, {"a": 2})):
        assert work.stage("s", settings, pages.where(f"page_no < {n}"), compute).count() == n
    assert seen == [1, 1, 2]  # only what is missing; other settings begin anew
    assert WorkFolder(spark, root, "one").stage("s", {"a": 2}, pages, compute).count() == 2 and seen[-1] == 0
    assert WorkFolder(spark, root, "two").stage("s", {"a": 2}, pages, compute).count() == 2 and seen[-1] == 2
    assert work.stage("s", {"a": 2}, pages, compute, force=True).count() == 2 and seen[-1] == 2
    assert work.contains(f"{root}/out") and not work.contains(str(tmp_path / "working"))
    work.cleanup()
    assert not (tmp_path / "work").exists()
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("x")
    for bad in (str(tmp_path / "full"), "/", "file://"):
        with pytest.raises(OptionError):
            WorkFolder(spark, bad, "one")
    with pytest.raises(OptionError):
        work.cleanup()


def test_giant_chapters_get_numbered_titles(spark):
    rows = [("b", 0, i, "p", "x" * 100, "") for i in range(10)] + [("b", 1, 0, "p", "y", ""), ("c", 0, 0, "p", "z" * 5000, "")]
    elements = spark.createDataFrame(rows, "book_id string, chapter_no int, elem_no int, kind string, text string, note_id string")
    heads = spark.createDataFrame([("b", 0, "big"), ("b", 1, "small"), ("c", 0, "one element")], "book_id string, chapter_no int, title string")
    new, chapters = C.with_split_giants(elements, heads, 500, 300)
    got = [(r.book_id, r.chapter_no, r.title, r.weight) for r in chapters.orderBy("book_id", "chapter_no").collect()]
    assert [t for b, _, t, _ in got if b == "b"] == ["big", "big (2)", "big (3)", "small"] and got[-1] == ("c", 0, "one element", 5000)
    assert sum(w for b, *_, w in got if b == "b") == 1001 and new.count() == len(rows)
    assert new.where("book_id = 'b' and chapter_no = 1 and elem_no = 0").count() == 1
    docs = spark.createDataFrame([("b", "# A\ntext"), ("empty", "<!-- page:0 -->")], "book_id string, markdown string")
    rows, heads = books.markdown_volumes(docs)
    assert [(r.chapter_no, r.text) for r in rows.where("book_id = 'empty'").collect()] == [(0, C.NO_TEXT)]
    assert [(r.title, r.volume_no) for r in heads.where("book_id = 'empty'").collect()] == [("فصل 1", 0)]


def test_own_drop_rule(spark):
    lines = spark.createDataFrame([("b", 0, i, t, 0, 20 * i, 400, 12, 12.0, 0.0) for i, t in enumerate(["keep this line of text.", "DROP this line of text.", "12"])], "book_id string, page_no int, line_no int, text string, x int, y int, w int, h int, size double, bold double")
    pages = spark.createDataFrame([("b", 0, 612, 792, False, None)], "book_id string, page_no int, page_w int, page_h int, is_image boolean, image_rel string")
    done = books.structure_books(lines, pages, None, books.Options(drop=F.col("norm").startswith("DROP"), footnotes=False))
    text = " ".join(r.text for r in done.elements.collect())
    assert "keep" in text and "DROP" not in text and "12" in text


def test_engines(spark):
    assert set(readers.engine_status()) == {"tesseract", "surya"}
    with pytest.raises(OptionError):
        readers.recognised(spark.range(1), "nobody", lambda x: x, "id long")


def test_command_line(spark, tmp_path, capsys):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(document(BOOK, info=b"<< /Title (One) >>"))
    (source / "b.pdf").write_bytes(b"%PDF-1.4 rubbish")
    (source / "c.md").write_text("---\ntitle: Three\nlanguage: en\n---\n# A\ntext\n# B\nmore\n", encoding="utf-8")
    assert cli.main(["inspect", str(source)], spark) == 0
    said = capsys.readouterr().out
    assert "a.pdf: 2 pages" in said and "b.pdf: malformed" in said
    assert cli.main(["convert", str(source), str(tmp_path / "out")], spark) == 0
    assert "malformed" in capsys.readouterr().err
    assert cli.main(["build", str(source), str(tmp_path / "out")], spark) == 0 and cli.main(["devices"], spark) == 0
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.epub", "c.epub"]
    opf = zipfile.ZipFile(tmp_path / "out" / "c.epub").read("OEBPS/content.opf").decode()
    assert "<dc:title>Three</dc:title>" in opf and "<dc:language>en" in opf


def test_too_many_notes_are_an_error(spark):
    lines = [("b", 0, 0, "body text", 100, 12, 12.0)] + [("b", 0, i, f"({i % 900}) note", 700 + i, 8, 8.0) for i in range(1, 203)]
    df = spark.createDataFrame(lines, "book_id string, page_no int, line_no int, text string, y int, h int, size double").withColumns({"page_h": F.lit(792), "body_size": F.lit(12.0)})
    assert N.split_notes(df.where("line_no < 201"))[1].count() == 200
    with pytest.raises(Exception, match="limit: over 200 notes on page 1"):
        N.split_notes(df)[1].collect()
