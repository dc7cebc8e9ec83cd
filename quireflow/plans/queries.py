"""Registered queries of the structuring engine over the driver's tables, with DuckDB SQL.

A book is a ``source`` of ``documents``, a page a document ranked by doc_id, a line an
element of its text. As the tables hold no page furniture and no Arabic,
two derived texts, built alike in both engines, give the rules something to do:
*furnished* pages get headers, list items, notes and page numbers by page
number; *arabized* ones have the letters a-z mapped to Arabic ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow import params as P
from quireflow.errors import page_indices
from quireflow.functions import rasters
from quireflow.functions import text as T
from quireflow.operators import chapters as C
from quireflow.operators import gate as G
from quireflow.operators import images
from quireflow.operators import lines as L
from quireflow.operators import markdown as M
from quireflow.operators import merge as B
from quireflow.operators import notes as N
from quireflow.operators import repeated as R
from quireflow.operators import report as A
from quireflow.operators import structure as S
from quireflow.plans import books
from quireflow.sinks import epub, files
from quireflow.sources import pdf, readers
from quireflow.stages import stage

_A, _B = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"
_PAGES = "SELECT source AS book_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page_no, doc_id, coalesce(text, '') AS text FROM documents"
_ITEMS = "'1. first point' || chr(10) || '2) second point' || chr(10) || '• third point'"
_FURNISHED = f"""concat_ws(chr(10), CASE WHEN page_no % 7 = 0 THEN 'https://books.example.org/' || page_no END, text,
 CASE WHEN page_no % 5 = 0 THEN {_ITEMS} END, CASE WHEN page_no % 4 = 0 THEN '* * *' END, CASE WHEN page_no % 3 = 0 THEN '- ' || (page_no + 1) || ' -' END)"""


def _lines_sql(text: str) -> str:
    return f"p AS MATERIALIZED ({_PAGES}), s AS (SELECT book_id, page_no, string_split({text}, chr(10)) AS ls FROM p), l AS MATERIALIZED (SELECT book_id, page_no, unnest(ls) AS text, CAST(unnest(range(0, len(ls))) AS INTEGER) AS line_no FROM s)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return L.document_pages(_docs(spark, d))


def _furnished_text() -> Column:
    n = F.col("page_no")
    return F.concat_ws("\n", F.when(n % 7 == 0, F.concat(F.lit("https://books.example.org/"), n)), "text", F.when(n % 5 == 0, F.lit("1. first point\n2) second point\n• third point")), F.when(n % 4 == 0, F.lit("* * *")), F.when(n % 3 == 0, F.concat(F.lit("- "), n + 1, F.lit(" -"))))


def _arabized(text: Column | str) -> Column:
    return F.translate(F.lower(text), _A, _B)


_ARABIZED = f"translate(lower(text), '{_A}', '{_B}')"


def _split(pages: DataFrame, text: Column) -> DataFrame:
    return pages.select("book_id", "page_no", F.posexplode(F.split(text, "\n", -1)).alias("line_no", "text"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _split(_pages(spark, d), F.col("text"))


def _furnished(spark: SparkSession, d: str) -> DataFrame:
    return _split(_pages(spark, d), _furnished_text())


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return L.flagged(_furnished(spark, d), P.LATIN)


def _geometry(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a box made from their lengths: 12 high, 22 apart, 10 more before every fifth; shorter ones keep the right margin."""
    n = F.char_length("text")
    return _lines(spark, d).where("trim(text) <> ''").select("book_id", "page_no", "line_no", "text", F.greatest(F.lit(0), 540 - n * 2).cast("int").alias("x"), (F.col("line_no") * 22 + F.floor(F.col("line_no") / 5) * 10).cast("int").alias("y"), F.least(F.lit(540), n * 2).cast("int").alias("w"), F.lit(12).alias("h"), F.lit(12.0).alias("size"), F.lit(0.0).alias("bold"))


def line_explode(spark: SparkSession, d: str) -> DataFrame:
    """S15, F02"""
    return L.visible(L.document_lines(_docs(spark, d)))


def line_drop_flags(spark: SparkSession, d: str) -> DataFrame:
    """F03-F07, T01"""
    return _flags(spark, d).select("book_id", "page_no", "line_no", "edge", "is_watermark", "is_page_number", "is_junk", "dropped")


def char_coverage_by_page(spark: SparkSession, d: str) -> DataFrame:
    """Every third element of every sixth page is lost, so that coverage differs"""
    flags = stage(_flags(spark, d))
    return A.page_report(L.char_counts(flags), S.flat(flags.where("not dropped")).where("page_no % 6 <> 2 or elem_no % 3 <> 0"))


def book_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A03"""
    return A.book_coverage(char_coverage_by_page(spark, d))


def coverage_warnings(spark: SparkSession, d: str) -> DataFrame:
    """A10: elements lost on every fourth page to have low ones."""
    flags = stage(_flags(spark, d))
    short = S.flat(flags.where("not dropped")).where("page_no % 4 <> 0 or elem_no % 2 = 0")
    return A.warnings(A.page_report(L.char_counts(flags), short))


def repeated_edges_exact(spark: SparkSession, d: str) -> DataFrame:
    """A01 without merging, at a ratio of 0.1"""
    return R.repeated_exact(_lines(spark, d), P.Repeated(min_ratio=0.1))


def repeated_edges_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """A01"""
    return R.repeated_lines(_lines(spark, d), P.Repeated(min_ratio=0.1))


def repeated_matches(spark: SparkSession, d: str) -> DataFrame:
    """J02"""
    lines = _lines(spark, d)
    mined = stage(R.repeated_lines(lines, P.Repeated(min_ratio=0.1)))
    return R.matching(lines.select("book_id", T.normalize(F.col("text")).alias("norm")), mined, P.Repeated(min_ratio=0.1))


def script_ratios(spark: SparkSession, d: str) -> DataFrame:
    """T04, T05 on half arabized texts with a private-use glyph every seventh page"""
    text = F.concat(F.when(F.col("page_no") % 2 == 0, _arabized("text")).otherwise(F.col("text")), F.when(F.col("page_no") % 7 == 0, F.repeat(F.lit(""), 100)).otherwise(""))
    return _pages(spark, d).select("book_id", "page_no", T.arabic_ratio(text).alias("arabic_ratio"), T.bad_glyph_ratio(text).alias("bad_glyph_ratio"))


def _layer(spark: SparkSession, d: str) -> DataFrame:
    broken = (F.col("page_no") % 5 == 0) | (F.substring("book_id", -1, 1) == "3") & (F.col("page_no") % 2 == 0)
    text = F.when(broken, F.regexp_replace(_arabized("text"), " ", " ل ")).otherwise(_arabized("text"))
    return _pages(spark, d).select("book_id", "page_no", F.concat(text, F.when(F.col("page_no") % 11 == 0, F.repeat(F.lit(""), 2000)).otherwise("")).alias("raw_text"))


_LAYER = f"""SELECT book_id, page_no, CASE WHEN page_no % 5 = 0 OR (right(book_id, 1) = '3' AND page_no % 2 = 0) THEN replace({_ARABIZED}, ' ', ' ل ') ELSE {_ARABIZED} END || CASE WHEN page_no % 11 = 0 THEN repeat(chr(57345), 2000) ELSE '' END AS raw_text FROM p"""


def corrupted_flag(spark: SparkSession, d: str) -> DataFrame:
    """T07, F10"""
    return _layer(spark, d).select("book_id", "page_no", T.corrupted(F.col("raw_text")).alias("corrupted"), G.defect(F.col("raw_text")).alias("defect"))


def text_layer_verdict(spark: SparkSession, d: str) -> DataFrame:
    """F08-F10"""
    return G.text_layer_verdict(stage(G.candidates(_layer(spark, d))))


def _recognised(spark: SparkSession, d: str) -> DataFrame:
    """Pages with made-up recognition results."""
    p = _pages(spark, d).withColumns({"word_count": T.words(F.col("text")), "mean_conf": (F.col("doc_id") * 37 % 100).cast("double"), "allowed": F.col("page_no") % 3 == 0, "rescued": F.col("page_no") % 2 == 0, "ratio": F.when(F.col("page_no") % 4 == 1, 0.5).otherwise(0.9), "image_page": F.when(F.col("page_no") % 10 == 1, True).when(F.col("page_no") % 10 < 6, False)})
    return p.withColumn("word_count", F.when(F.col("page_no") % 13 == 4, 0).otherwise(F.col("word_count")))


def page_routes(spark: SparkSession, d: str) -> DataFrame:
    """F11-F13, F20"""
    return G.routed(_recognised(spark, d)).select("book_id", "page_no", "route", "reason")


def route_counts(spark: SparkSession, d: str) -> DataFrame:
    """A04"""
    return G.route_counts(G.routed(_recognised(spark, d)))


def layer_reasons(spark: SparkSession, d: str) -> DataFrame:
    """J08"""
    verdicts = stage(G.text_layer_verdict(G.candidates(_layer(spark, d))))
    return G.with_layer_reason(G.routed(_recognised(spark, d)), verdicts).select("book_id", "page_no", "route", "reason")


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """A15"""
    return A.run_summary(_recognised(spark, d))


def rescue_candidates(spark: SparkSession, d: str) -> DataFrame:
    """F12"""
    return _recognised(spark, d).where(~F.col("allowed") & G.needs_rescue(F.col("mean_conf"))).select("book_id", "page_no", "mean_conf")


def inspected_books(spark: SparkSession, d: str) -> DataFrame:
    """S19, A16, U02, O04"""
    return G.inspected(_layer(spark, d))


def stage_anti(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose document has no label yet"""
    done = _pages(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id").distinct(), "doc_id", "left_semi")
    return G.missing(_pages(spark, d), done).select("book_id", "page_no")


def modal_size(spark: SparkSession, d: str) -> DataFrame:
    """Sizes from line lengths"""
    return S.body_sizes(_lines(spark, d).withColumn("size", F.char_length("text") % 9 + 0.5))


def paragraph_segments(spark: SparkSession, d: str) -> DataFrame:
    """W01, W02, T06, A08"""
    return S.paragraphs(_geometry(spark, d).withColumn("run", F.lit(0)))


def heading_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Four sizes by line length, every fourth page bold, two of three lines centred"""
    n = F.char_length("text")
    size = F.when(n < 25, 24.0).when(n < 35, 17.0).when(n < 45, 14.4).otherwise(12.0)
    x = F.when(F.col("line_no") % 3 == 0, 0).otherwise(((612 - F.col("w")) / 2).cast("int"))
    g = _geometry(spark, d).withColumns({"size": size, "bold": F.when(F.col("page_no") % 4 == 0, 0.7).otherwise(0.1), "x": x, "body_size": F.lit(12.0), "page_w": F.lit(612)})
    return S.heading_tiers(g).where("tier is not null").select("book_id", "page_no", "line_no", "tier")


def list_islands(spark: SparkSession, d: str) -> DataFrame:
    """W04, T13"""
    return S.list_islands(_furnished(spark, d)).where("item is not null").select("book_id", "page_no", "line_no", F.col("item.kind").alias("kind"), F.col("item.text").alias("item"))


def _verses(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of arabized pages as lines of seven words, every third page with one rhyme."""
    tail = F.when(F.col("page_no") % 3 == 0, " سلوان").otherwise("")

    def sevens(sentence: Column) -> Column:
        words = F.split(F.trim(sentence), " +")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 7).cast("int")), lambda i: F.concat(F.array_join(F.slice(words, i * 7 + 1, F.lit(7)), " "), tail))

    parts = F.flatten(F.transform(F.filter(F.split(_arabized("text"), "[.\n]"), lambda x: F.trim(x) != ""), sevens))
    return _pages(spark, d).select("book_id", "page_no", F.posexplode(parts).alias("line_no", "text"))


def verse_islands(spark: SparkSession, d: str) -> DataFrame:
    """W03, A14, F15, T09"""
    return S.verse_islands(_verses(spark, d)).where("verse").select("book_id", "page_no", "line_no")


def _noted(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose lines end with one citing (1) and, every other page, [2], and two notes below; of ``n_body`` lines the last one cites."""
    n = F.col("page_no")
    lines = F.split(F.translate("text", "()[]", ""), "\n", -1)
    body = F.array_append(lines, F.when(n % 2 == 0, "as said (1) and [2] there").otherwise("as said (1) and (1) there"))
    notes = F.array(F.lit("(1) first source"), F.lit("continued below"), F.lit("2- second source"))
    # split once a page, below the generator: beside it, each line would split its whole page again, as would the filter of empty arrays that a plain one brings
    pages = _pages(spark, d).select("book_id", "page_no", body.alias("body")).select("book_id", "page_no", F.size("body").alias("n_body"), F.concat("body", notes, F.array((n + 1).cast("string"))).alias("lines"))
    texts = pages.select("book_id", "page_no", "n_body", F.posexplode_outer("lines").alias("line_no", "text"))
    low = F.col("line_no") >= F.col("n_body")
    return texts.where("trim(text) <> ''").select("book_id", "page_no", "line_no", "text", F.when(low, 700 + (F.col("line_no") - F.col("n_body")) * 12).otherwise(60 + F.col("line_no") * 20).alias("y"), F.when(low, 8).otherwise(12).alias("h"), F.when(low, 8.0).otherwise(12.0).alias("size"), F.lit(792).alias("page_h"), F.lit(12.0).alias("body_size"), "n_body")


def footnote_split(spark: SparkSession, d: str) -> DataFrame:
    """W06, W07, W16, F17, F21, T15"""
    return N.split_notes(_noted(spark, d))[1]


def footnote_refs(spark: SparkSession, d: str) -> DataFrame:
    """J10, U04"""
    body, notes = N.split_notes(stage(_noted(spark, d)))
    elements = stage(body.where("line_no = n_body - 1").select("book_id", "page_no", F.col("line_no").alias("elem_no"), F.lit("p").alias("kind"), "text"))
    notes = stage(notes)
    return N.with_notes(N.linked(elements, notes), notes)


def context_window(spark: SparkSession, d: str) -> DataFrame:
    """All lines, every fifth in brackets behind a cue, every fifth before a source"""
    n = F.col("line_no")
    text = F.when(n % 5 == 1, F.concat(F.lit("«"), "text", F.lit("»"))).otherwise(F.col("text"))
    more = F.when(n % 5 == 0, "قال تعالى").when(n % 5 == 3, "سورة البقرة")
    pair = F.explode(F.array_compact(F.array(F.struct((n * 2).alias("line_no"), text.alias("text")), F.when(more.isNotNull(), F.struct((n * 2 + 1).alias("line_no"), more.alias("text"))))))
    return S.quotations(_lines(spark, d).where("trim(text) <> ''").select("book_id", "page_no", pair.alias("e")).select("book_id", "page_no", "e.line_no", F.lit("p").alias("kind"), "e.text"))


def boundary_merge(spark: SparkSession, d: str) -> DataFrame:
    """W09"""
    elements = _merge_elements(spark, d)
    pages = _pages(spark, d).select("book_id", "page_no", (F.col("page_no") % 17 == 16).alias("is_image"))
    return B.merge_boundaries(elements, pages).select("book_id", "page_no", "elem_no", "kind", "text")


def _merge_elements(spark: SparkSession, d: str) -> DataFrame:
    """A page's text as one element, on every third page its first line and the rest; most without terminal punctuation."""
    lines = F.transform(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.when(F.col("page_no") % 6 == 5, x).otherwise(F.regexp_replace(x, "[.!:]+$", "")))
    rest = F.slice(lines, F.lit(2), F.size(lines))
    two = F.array_compact(F.array(F.get(lines, F.lit(0)), F.when(F.size(rest) > 0, F.array_join(rest, " "))))
    texts = F.when(F.col("page_no") % 3 == 1, two).otherwise(F.when(F.size(lines) > 0, F.array(F.array_join(lines, " "))).otherwise(F.array().cast("array<string>")))
    return stage(_pages(spark, d).select("book_id", "page_no", F.posexplode(texts).alias("elem_no", "text"), F.lit("p").alias("kind")))


def _html_elements(spark: SparkSession, d: str) -> DataFrame:
    """Headings, paragraphs and items of pages; a book is a host."""
    p = spark.read.parquet(f"{d}/pages.parquet").withColumn("book_id", F.regexp_extract("url", "//([^/]*)", 1))
    w = Window.partitionBy("book_id").orderBy("page_id")
    p = p.withColumn("page_no", F.row_number().over(w) - 1)
    parts = p.select("book_id", "page_no", F.posexplode(F.regexp_extract_all("html", F.lit("<(?:h1|p|li)>(?:<[^>]*>)*[^<]+"), F.lit(0))).alias("elem_no", "raw"))
    kind = F.when(F.col("raw").startswith("<h1"), "h1").when(F.col("raw").startswith("<li"), "ul").otherwise("p")
    return parts.select("book_id", "page_no", "elem_no", kind.alias("kind"), F.trim(F.regexp_replace("raw", "<[^>]*>", "")).alias("text")).where("text <> ''")


def html_elements(spark: SparkSession, d: str) -> DataFrame:
    return _html_elements(spark, d)


def markdown_emit(spark: SparkSession, d: str) -> DataFrame:
    """K10, W05, T17-T19"""
    elements = stage(_html_elements(spark, d))
    return M.emit_pages(elements, elements.select("book_id", "page_no").distinct().withColumn("image_rel", F.lit(None).cast("string")))


def _html_books(spark: SparkSession, d: str) -> DataFrame:
    return stage(M.emit_books(markdown_emit(spark, d)))


def markdown_parse(spark: SparkSession, d: str) -> DataFrame:
    """S17"""
    return M.parse_books(_html_books(spark, d))


def markdown_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """K10 then S17 give the elements back."""
    items = M.parse_books(_html_books(spark, d))
    order = Window.partitionBy("book_id", "page_no").orderBy("item_no")
    return items.select("book_id", "page_no", (F.row_number().over(order) - 1).alias("elem_no"), "kind", "text")


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """S16"""
    text = F.concat(F.lit("---\nTitle: book "), "doc_id", F.lit("\nauthor: 'someone'\n"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("---\n"), F.coalesce("text", F.lit("")))
    out = M.front_matter(_docs(spark, d).select("doc_id", text.alias("markdown")))
    return out.select("doc_id", F.try_element_at("meta", F.lit("title")).alias("title"), F.try_element_at("meta", F.lit("author")).alias("author"), F.char_length("body").alias("body_chars"))


def _chapter_items(spark: SparkSession, d: str) -> DataFrame:
    return M.parse_books(_html_books(spark, d))


def chapters_by_heading(spark: SparkSession, d: str) -> DataFrame:
    """A13, W10, W11, W15, A12, T08"""
    return C.chapters(stage(C.chaptered(stage(_chapter_items(spark, d)))))


def chapters_every_n(spark: SparkSession, d: str) -> DataFrame:
    """W12"""
    w = Window.partitionBy("book_id").orderBy("page_no", "line_no")
    items = _lines(spark, d).where("trim(text) <> ''").select("book_id", (F.row_number().over(w) - 1).alias("item_no"), "page_no", F.lit("p").alias("kind"), "text", F.lit("").alias("note_id"))
    return C.chapters(C.chaptered(items, 10))


def volume_chunks(spark: SparkSession, d: str) -> DataFrame:
    """W13"""
    return C.volumes(stage(chapters_every_n(spark, d)), 3).select("book_id", "chapter_no", "volume_no")


def _giant_elements(spark: SparkSession, d: str) -> DataFrame:
    """Ten pages a chapter; ``elem_no`` passes the range of an int in books of more than 21,474 pages."""
    number = F.col("page_no").cast("long") * 100000 + F.col("line_no")
    return stage(_lines(spark, d).where("trim(text) <> ''").select("book_id", F.floor(F.col("page_no") / 10).cast("int").alias("chapter_no"), number.alias("elem_no"), F.lit("p").alias("kind"), "text"))


def giant_split(spark: SparkSession, d: str) -> DataFrame:
    """W14; ``elem_no`` is an int as in SQL, and a long where an int, and so the SQL, cannot hold it"""
    elements = _giant_elements(spark, d)
    kind = "long" if (elements.agg(F.max("elem_no")).first()[0] or 0) > 2**31 - 1 else "int"
    return C.split_giants(elements, 40_000, 25_000).select("book_id", "chapter_no", F.col("elem_no").cast(kind).alias("elem_no"), "part_no")


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """A chapter a page; references in every line 1, their notes one page later."""
    n = F.col("page_no")

    def element(no: int, kind: str, text: Column, note: Column, title: bool) -> Column:
        return F.struct(F.lit(no).alias("elem_no"), F.lit(kind).alias("kind"), text.alias("text"), note.alias("note_id"), F.lit(title).alias("is_title"))

    none = F.lit("")
    head = element(0, "h1", F.concat(F.lit("part "), n), none, True)
    body = element(1, "p", F.concat(F.lit("see [^n"), n, F.lit("] and [^n"), n, F.lit("] and [^x]")), none, False)
    note = element(2, "footnote", F.lit("source"), F.concat(F.lit("n"), F.when(n % 3 == 0, n).otherwise(n - 1)), False)
    base = _pages(spark, d).select("book_id", n.alias("chapter_no"), F.explode(F.array(head, body, note)).alias("e"), n.alias("page_no"))
    return base.select("book_id", "chapter_no", "page_no", "e.*")


def footnote_relocate(spark: SparkSession, d: str) -> DataFrame:
    """J09"""
    return C.relocated(_cited(spark, d)).select("book_id", "chapter_no", "elem_no", "kind", "note_id")


def references(spark: SparkSession, d: str) -> DataFrame:
    """J05"""
    return C.references(_cited(spark, d))


def note_numbers(spark: SparkSession, d: str) -> DataFrame:
    """W17, T16"""
    return C.note_numbers(_cited(spark, d).withColumn("chapter_no", F.floor(F.col("chapter_no") / 5).cast("int")).withColumn("elem_no", F.col("page_no") * 10 + F.col("elem_no")))


def manifest_integrity(spark: SparkSession, d: str) -> DataFrame:
    """J06"""
    p = _pages(spark, d).select("book_id", F.col("page_no").alias("n"))
    name = F.concat(F.lit("text/"), "n", F.lit(".xhtml"))
    manifest = p.select("book_id", F.concat(F.lit("c"), F.when(F.col("n") % 20 == 19, F.col("n") - 1).otherwise(F.col("n"))).alias("item_id"), name.alias("href"))
    files = p.where("n % 6 <> 5").select("book_id", name.alias("name"))
    spine = p.select("book_id", F.concat(F.lit("c"), F.col("n")).alias("item_id"))
    hrefs = p.select("book_id", F.concat(F.lit("text/"), F.col("n") + 1, F.lit(".xhtml#top")).alias("target"))
    return A.integrity(manifest, files, spine, hrefs)


def missing_scans(spark: SparkSession, d: str) -> DataFrame:
    """J11, O04"""
    path = F.concat(F.lit("scans/page_"), F.lpad(F.col("page_no").cast("string"), 4, "0"), F.lit(".jpg"))
    p = _pages(spark, d).select("book_id", "page_no", F.lit("img").alias("kind"), path.alias("text"))
    return A.missing_scans(p, p.where("page_no % 3 <> 0").select("book_id", F.col("text").alias("path")))


def covers(spark: SparkSession, d: str) -> DataFrame:
    """O05"""
    return C.covers(_pages(spark, d).withColumn("kind", F.when((F.col("page_no") > 0) & (F.col("doc_id") % 2 == 0), "img").otherwise("p")))


def toc_pages(spark: SparkSession, d: str) -> DataFrame:
    """O06"""
    return C.toc_pages(_pages(spark, d).select("book_id", "page_no"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Words of pages as recognised boxes, ten a row, four rows a paragraph."""
    w = _pages(spark, d).select("book_id", "page_no", F.posexplode(F.filter(F.split("text", "[ \n]+"), lambda x: x != "")).alias("i", "text"))
    i = F.col("i")
    return w.select("book_id", "page_no", F.lit(0).alias("block_no"), F.floor(i / 40).cast("int").alias("par_no"), (F.floor(i / 10) % 4).cast("int").alias("row_no"), (i % 10).alias("word_no"), "text", F.when(i % 13 == 0, -1).otherwise(i * 7 % 100).cast("double").alias("conf"), (500 - (i % 10) * 50 - F.when(i % 10 >= 5, 80).otherwise(0)).cast("int").alias("x"), (F.floor(i / 10) * 20 + i % 3).cast("int").alias("y"), F.lit(40).alias("w"), (12 + i % 2).cast("int").alias("h"))


def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    """A02, A06, S10's grouping"""
    return L.lines_of_words(_words(spark, d))


def ocr_confidence(spark: SparkSession, d: str) -> DataFrame:
    """A02"""
    return L.page_confidence(_words(spark, d))


def hemistichs(spark: SparkSession, d: str) -> DataFrame:
    """W18, T10"""
    return L.split_hemistichs(_words(spark, d).withColumn("line_no", F.col("par_no") * 4 + F.col("row_no")))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """O02"""
    return L.reading_order(_words(spark, d).select("book_id", "page_no", "x", "y", "par_no")).groupBy("book_id", "page_no").agg(F.max("line_no").alias("last_line"), F.max_by("x", "line_no").alias("last_x"))


def boxed_chars(spark: SparkSession, d: str) -> DataFrame:
    """J07, A08, S06"""
    w = _words(spark, d)
    chars = w.select("book_id", "page_no", "x", "y", F.lit(4).alias("w"), F.lit(8).alias("h"), (F.col("h") * 1.0).alias("size"), F.when(F.col("word_no") % 3 == 0, 700).otherwise(400).alias("weight"))
    rects = w.groupBy("book_id", "page_no", "par_no", "row_no").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + 40) - F.min("x")).alias("w"), F.lit(15).alias("h")).withColumn("rect_no", F.col("par_no") * 4 + F.col("row_no"))
    return L.boxed_chars(chars, rects)


def scalar_texts(spark: SparkSession, d: str) -> DataFrame:
    """T02, T03, T08, T16, T18, T20, T22, T23 over whole texts"""
    line = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))
    path = F.concat(F.lit("/in/noor-book.com "), "source", F.lit("_.pdf"))
    return _docs(spark, d).select("doc_id", T.fuzzy_key(line).alias("key"), T.coverage_chars(F.col("text")).alias("chars"), T.clean_heading(F.concat(F.lit("12 - "), line, F.lit(" |_ "))).alias("heading"), T.arabic_digits(F.col("doc_id")).alias("digits"), T.title_of_path(path).alias("title"), T.language_tag(F.col("lang")).alias("tag"), T.xml_escape(F.concat(F.lit("<&>"), "lang")).alias("xml"), T.volume_name(F.col("source"), F.col("doc_id") % 3 + 1, F.col("doc_id") % 2 + 1).alias("volume"), T.settings_hash(F.col("source")).alias("hash"))


def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """T06"""
    return _docs(spark, d).select("doc_id", T.join_lines(F.split(F.replace(F.col("text"), F.lit("e "), F.lit("e-\n")), "\n", -1)).alias("text"))


def selected_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a list of overlapping ranges"""
    return _pages(spark, d).where(F.col("page_no").isin(page_indices("2-4,3-6,9,1", 9))).select("book_id", "page_no")


def _reported(spark: SparkSession, d: str) -> DataFrame:
    """A report with routes, and notes on some pages."""
    n = F.col("page_no")
    notes = F.array_compact(F.array(F.when(n % 3 == 0, "flat layout"), F.when(n % 5 == 0, "foreign script")))
    return _pages(spark, d).select("book_id", "page_no", F.when(n % 4 == 1, "image-kept").when(n % 4 == 2, "ocr").otherwise("text-layer").alias("route"), notes.alias("notes"), F.char_length("text").cast("long").alias("source_chars"), (F.char_length("text") - n % 7).cast("long").alias("emitted_chars"))


def degraded_pages(spark: SparkSession, d: str) -> DataFrame:
    """A11, O04"""
    return A.degraded(_reported(spark, d)).select("book_id", "page_no", "nth", F.array_join("notes", "; ").alias("notes"))


def console_report(spark: SparkSession, d: str) -> DataFrame:
    """K15, A03, A04, A11"""
    return files.console(_reported(spark, d))


def recognised_pages(spark: SparkSession, d: str) -> DataFrame:
    """Words to page JSON and back to lines"""
    words = _words(spark, d).withColumn("line_no", F.col("par_no") * 4 + F.col("row_no"))
    return readers.ocr_pages(files.page_json(words)).select("book_id", "page_no", "line_no", "text", "x", "y", "w", "h", "conf")


def archived_pages(spark: SparkSession, d: str) -> DataFrame:
    """An archive a book"""
    pages = _pages(spark, d).select("book_id", F.lit(0).alias("volume_no"), "page_no", F.lit("txt").alias("extension"), F.encode("text", "UTF-8").alias("content"))
    return files.cbz(pages).select("book_id", "volume_no", F.length("cbz").alias("n_bytes"), F.sha2("cbz", 256).alias("sha256"))


def giant_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles and weights after giant chapters are cut"""
    elements = _giant_elements(spark, d)
    heads = elements.select("book_id", "chapter_no").distinct().withColumn("title", F.concat(F.lit("part "), "chapter_no"))
    return C.with_split_giants(elements, heads, 40_000, 25_000)[1]


def _pdf_files(spark: SparkSession, d: str) -> DataFrame:
    """A one-page PDF of every document: its lines at 10 points, 14 apart."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    height = F.size(lines) * 14 + 40

    def shown(line: Column, i: Column) -> Column:
        return F.concat(F.lit("BT /F1 10 Tf 1 0 0 1 20 "), height - 20 - i * 14, F.lit(" Tm <"), F.hex(F.encode(line, "UTF-16BE")), F.lit("> Tj ET"))

    head = "%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n3 0 obj\n<< /Type /Font /Subtype /Type0 /BaseFont /Plain /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>\nendobj\n4 0 obj\n<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Plain /DW 500 >>\nendobj\n5 0 obj\n<< >>\nstream\n1 beginbfrange\n<0020> <024F> <0020>\nendbfrange\nendstream\nendobj\n"
    page = F.concat(F.lit("2 0 obj\n<< /Type /Pages /Count 1 /Kids [6 0 R] /MediaBox [0 0 612 "), height, F.lit("] >>\nendobj\n6 0 obj\n<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents 7 0 R >>\nendobj\n7 0 obj\n<< >>\nstream\n"), F.array_join(F.transform(lines, shown), "\n"), F.lit("\nendstream\nendobj\n8 0 obj\n<< /Title (document "), "doc_id", F.lit(") >>\nendobj\ntrailer\n<< /Root 1 0 R /Info 8 0 R >>\n%%EOF\n"))
    return _docs(spark, d).select(F.col("doc_id").cast("string").alias("book_id"), F.when(F.col("doc_id") % 10 == 9, F.encode(F.lit("no PDF"), "UTF-8")).otherwise(F.encode(F.concat(F.lit(head), page), "UTF-8")).alias("content"))


def pdf_text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of PDF text layers"""
    return pdf.pdf_lines(pdf.pdf_pages(_pdf_files(spark, d))).select("book_id", "page_no", "line_no", "text", "x", "w", "size", "bold")


def pdf_file_table(spark: SparkSession, d: str) -> DataFrame:
    """A row a file, every tenth of them broken"""
    pages = stage(pdf.pdf_pages(_pdf_files(spark, d)).withColumn("n_chars", F.char_length("raw_text")).drop("raw_text", "lines"))
    texts = pages.groupBy("book_id").agg(F.max("n_chars").alias("n_chars"), F.max("page_h").alias("page_h"))
    return pdf.pdf_books(pages).join(texts, "book_id").select("book_id", "n_pages", "title", "degraded", "error", "n_chars", "page_h")


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    """A page image of every document: a bar a line, as long as the line; every eleventh page is dark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for page_no, sizes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                page = np.full((12 * len(sizes) + 24, 160), 250, np.uint8)
                for i, n in enumerate(sizes):
                    page[12 * i + 12 : 12 * i + 17, 20 : 20 + min(120, n)] = 30
                made.append(rasters.png(page // 4 if page_no % 11 == 10 else page))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["book_id", "page_no", "content"])

    sizes = F.transform(F.split("text", "\n", -1), F.char_length)
    return _pages(spark, d).select("book_id", "page_no", sizes.alias("sizes")).mapInArrow(run, "book_id string, page_no int, content binary")


def image_measures(spark: SparkSession, d: str) -> DataFrame:
    """I01, I04-I06, I08, I15, F14, W19, W20"""
    return images.measured(_drawn(spark, d), 120, 100).select("book_id", "page_no", "width", "height", "level", "skew", "line_height", "picture", "fit_w", "fit_h")


def device_pages(spark: SparkSession, d: str) -> DataFrame:
    """S21"""
    keys = F.array(*(F.lit(x[0]) for x in P.DEVICES))
    p = _pages(spark, d).select("book_id", "page_no", F.get(keys, (F.col("page_no") % 5).cast("int")).alias("key"))
    return p.join(F.broadcast(readers.devices(spark)), "key").groupBy("key", "width", "height").agg(F.count("*").alias("pages"))


def _book_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = _split(_pages(spark, d), _furnished_text()).where("trim(text) <> ''")
    n = F.char_length("text")
    boxed = lines.select("book_id", "page_no", "line_no", "text", F.greatest(F.lit(0), 540 - n * 2).cast("int").alias("x"), (F.col("line_no") * 22).cast("int").alias("y"), F.least(F.lit(540), n * 2).cast("int").alias("w"), F.lit(12).alias("h"), F.lit(12.0).alias("size"), F.lit(0.0).alias("bold"))
    pages = _pages(spark, d).select("book_id", "page_no", F.lit(612).alias("page_w"), F.lit(100000).alias("page_h"), F.lit(False).alias("is_image"), F.lit(None).cast("string").alias("image_rel"))
    return boxed, pages


def structured_books(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan, lines to elements"""
    lines, pages = _book_lines(spark, d)
    return books.structure_books(lines, pages, None, books.Options(script=P.LATIN, repeated=P.Repeated(min_ratio=0.1))).elements


def structured_report(spark: SparkSession, d: str) -> DataFrame:
    """A09, K12 over the whole plan"""
    lines, pages = _book_lines(spark, d)
    return A.report_json(books.structure_books(lines, pages, None, books.Options(script=P.LATIN)).report)


def epub_bytes(spark: SparkSession, d: str) -> DataFrame:
    """A volume a row"""
    elements = stage(C.relocated(C.chaptered(stage(_chapter_items(spark, d)))))
    volumes = C.volumes(C.chapters(elements), 2)
    meta = elements.select("book_id").distinct().select("book_id", F.col("book_id").alias("title"), F.lit("").alias("author"), F.lit("en").alias("language"))
    return epub.epubs(elements, volumes, meta).select("book_id", "volume_no", "n_chapters", F.length("epub").alias("n_bytes"), "sha256")


def book_json(spark: SparkSession, d: str) -> DataFrame:
    """K13"""
    return A.book_json(C.chaptered(stage(_chapter_items(spark, d))))


Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {
    f.__name__: f
    for f in (
        line_explode, line_drop_flags, char_coverage_by_page, book_coverage, coverage_warnings, repeated_edges_exact, repeated_edges_fuzzy, repeated_matches, script_ratios, corrupted_flag, text_layer_verdict,
        page_routes, route_counts, layer_reasons, run_summary, rescue_candidates, inspected_books, stage_anti, modal_size, paragraph_segments, heading_tiers, list_islands, verse_islands, footnote_split, footnote_refs,
        context_window, boundary_merge, html_elements, markdown_emit, markdown_parse, markdown_roundtrip, front_matter, chapters_by_heading, chapters_every_n, volume_chunks, giant_split, footnote_relocate, references,
        note_numbers, manifest_integrity, missing_scans, covers, toc_pages, ocr_lines, ocr_confidence, hemistichs, reading_order, boxed_chars, scalar_texts, joined_lines, device_pages, structured_books,
        structured_report, epub_bytes, book_json, selected_pages, degraded_pages, console_report, recognised_pages, archived_pages, giant_titles, pdf_text_lines, pdf_file_table, image_measures,
    )
}
