"""A thin command line over the engine [X05]: build, convert, inspect, devices.

It starts a local session unless one is submitted to; every command is a few
calls of the Python API, and errors end with their code and a status of 2.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow import params as P
from quireflow.errors import QuireError
from quireflow.operators import gate, markdown
from quireflow.plans import books
from quireflow.sinks import epub
from quireflow.sources import pdf, readers
from quireflow.stages import stage


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quireflow", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("build", "Markdown files of a folder to e-books"), ("convert", "PDF files of a folder to e-books by their text layers"), ("inspect", "what PDF files of a folder hold")):
        one = commands.add_parser(name, help=text)
        one.add_argument("folder")
        if name != "inspect":
            one.add_argument("out")
            one.add_argument("--volumes", type=int, default=1)
            one.add_argument("--split-every", type=int, default=10)
        if name == "convert":
            one.add_argument("--latin", action="store_true", help="no tests for Arabic script")
            one.add_argument("--strip-pattern", action="append", default=[], help="a Java regular expression of lines to drop")
    commands.add_parser("devices", help="the device table")
    return top


def _title(book: str = "book_id"):  # noqa: ANN202
    return F.regexp_extract(book, r"([^/]+?)(\.[^./]*)?$", 1)


def _write(volumes: DataFrame, out: str) -> int:
    """Files named after their books; each is fetched alone."""
    Path(out).mkdir(parents=True, exist_ok=True)
    n = 0
    named = stage(volumes.withColumn("title", _title()))
    total = {r.book_id: r.n for r in named.groupBy("book_id").agg(F.count("*").alias("n")).toLocalIterator()}
    for row in named.toLocalIterator():
        name = row.title if total[row.book_id] == 1 else f"{row.title} - {row.volume_no + 1}"
        Path(out, f"{name}.epub").write_bytes(bytes(row.epub))
        n += 1
    return n


def _epubs(docs: DataFrame, meta: DataFrame, volumes: int, split_every: int) -> DataFrame:
    elements, chapters = books.markdown_volumes(docs, volumes, split_every)
    return epub.epubs(elements, chapters, meta)


def build(spark: SparkSession, folder: str, out: str, volumes: int = 1, split_every: int = 10) -> int:
    """Markdown files to e-books: title, author and language from the front matter, else from the file's name."""
    docs = stage(markdown.front_matter(readers.markdown_files(spark, folder)))

    def said(key: str, default):  # noqa: ANN001, ANN202
        return F.coalesce(F.nullif(F.try_element_at("meta", F.lit(key)), F.lit("")), default).alias(key)

    meta = docs.select("book_id", said("title", _title()), said("author", F.lit("")), said("language", F.lit("ar")))
    return _write(_epubs(docs.select("book_id", F.col("body").alias("markdown")), meta, volumes, split_every), out)


def convert(spark: SparkSession, folder: str, out: str, volumes: int = 1, split_every: int = 10, latin: bool = False, patterns: list[str] | None = None) -> int:
    """PDF files with text layers to e-books; files that cannot be opened are named on standard error."""
    pages = stage(pdf.pdf_pages(pdf.pdf_files(spark, folder)))
    for row in pages.where("error is not null").select("book_id", "error").toLocalIterator():
        print(f"{row.book_id}: {row.error}", file=sys.stderr)
    good = pages.where("error is null")
    sheets = good.select("book_id", "page_no", "page_w", "page_h", F.lit(False).alias("is_image"), F.lit(None).cast("string").alias("image_rel"))
    allowed = gate.text_layer_verdict(gate.candidates(good)).where("allowed").select("book_id", "page_no") if not latin else good.select("book_id", "page_no")
    lines = pdf.pdf_lines(good).join(allowed, ["book_id", "page_no"], "left_semi")
    done = books.structure_books(lines, sheets, None, books.Options(script=P.LATIN if latin else P.ARABIC, patterns=patterns or []))
    meta = good.groupBy("book_id").agg(F.max("title").alias("t"), F.max("author").alias("a")).select("book_id", F.coalesce("t", _title()).alias("title"), F.coalesce("a", F.lit("")).alias("author"), F.lit("en" if latin else "ar").alias("language"))
    return _write(_epubs(stage(books.books_markdown(done)), meta, volumes, split_every), out)


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, n_pages, title, error, sampled, with_text, avg_chars) of the PDF files of a folder [S18, S19]."""
    pages = stage(pdf.pdf_pages(pdf.pdf_files(spark, folder)))
    return pdf.pdf_books(pages).join(gate.inspected(pages.where("error is null").select("book_id", "page_no", "raw_text")), "book_id", "left").select("book_id", "n_pages", "title", "error", "sampled", "with_text", "avg_chars")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quireflow").getOrCreate()
    try:
        if args.command == "devices":
            for key, label, width, height, ppi in P.DEVICES:
                print(f"{key}: {label}, {width} x {height}, {ppi} ppi")
        elif args.command == "inspect":
            for row in inspect(spark, args.folder).orderBy("book_id").toLocalIterator():
                print(f"{row.book_id}: {row.error or f'{row.n_pages} pages, {row.with_text} of {row.sampled} sampled with text'}")
        elif args.command == "build":
            print(f"{build(spark, args.folder, args.out, args.volumes, args.split_every)} files")
        else:
            print(f"{convert(spark, args.folder, args.out, args.volumes, args.split_every, args.latin, args.strip_pattern)} files")
    except QuireError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
