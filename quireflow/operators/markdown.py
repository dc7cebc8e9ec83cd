"""Markdown: emitting elements, parsing documents [K10, S16, S17, T17-T19, W05, W10, X03].

The parser is a fold over a document's lines with an open fence as its state; it
runs document by document in Arrow batches, and also as a table function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quireflow import params as P
from quireflow.functions import text as T

PAGE = ["book_id", "page_no"]
FENCED = ["verse", "quran"]


def emit_pages(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, page_no, markdown) of all pages; ``pages`` has image_rel, null for pages without a scan."""
    w = Window.partitionBy(*PAGE).orderBy("elem_no")
    text, kind = T.escape_inline(F.col("text")), F.col("kind")
    note = F.sum((kind == "footnote").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    line = (
        F.when(kind.isin(FENCED), text)
        .when(kind == "footnote", F.concat(F.lit("[^p"), F.col("page_no") + 1, F.lit("-"), note, F.lit("]: "), text))
        .when(kind == "h1", F.concat(F.lit("# "), text))
        .when(kind == "h2", F.concat(F.lit("## "), text))
        .when(kind == "h3", F.concat(F.lit("### "), text))
        .when(kind == "ul", F.concat(F.lit("- "), text))
        .when(kind == "ol", F.concat(F.lit("1. "), text))
        .otherwise(T.escape_start(text))
    )
    opens = kind.isin(FENCED) & ~F.coalesce(F.lag("kind").over(w) == kind, F.lit(False))
    closes = kind.isin(FENCED) & ~F.coalesce(F.lead("kind").over(w) == kind, F.lit(False))
    full = F.concat(F.when(opens, F.concat(F.lit(":::"), kind, F.lit("\n"))).otherwise(""), line, F.when(closes, "\n:::").otherwise(""))
    body = elements.select(*PAGE, "elem_no", full.alias("md")).groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("elem_no", "md"))), lambda x: x["md"]), "\n").alias("body"))
    scan = F.when(F.col("image_rel").isNotNull(), F.concat(F.lit("![scan]("), F.col("image_rel"), F.lit(")")))
    joined = pages.select(*PAGE, "image_rel").join(body, PAGE, "left")
    return joined.select(*PAGE, F.concat_ws("\n", F.concat(F.lit("<!-- page:"), F.col("page_no"), F.lit(" -->")), scan, "body").alias("markdown"))


def emit_books(pages: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(book_id, markdown): the pages of a book in order, after front matter where ``meta`` (title, author, language) is given."""
    books = pages.groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "markdown"))), lambda x: x["markdown"]), "\n").alias("markdown"))
    if meta is None:
        return books
    given = [F.when(T.strip(F.coalesce(k, F.lit(""))) != "", F.concat(F.lit(f"{k}: "), T.strip(F.col(k)))) for k in ("title", "author", "language")]
    head = F.concat_ws("\n", F.lit("---"), *given, F.lit("---"), F.lit(""))
    return books.join(meta, "book_id", "left").select("book_id", F.concat_ws("\n", head, "markdown").alias("markdown"))


def front_matter(docs: DataFrame) -> DataFrame:
    """Adds ``meta`` (map) and ``body`` [S16]; without a closed block at the very start the text is all body.

    The last of equal keys counts.
    """
    lines = F.split("markdown", "\n", -1)
    out = docs.withColumn("ls", lines).withColumn("end", F.when(T.strip(F.get("ls", F.lit(0))) == "---", F.array_position(F.transform(F.slice("ls", 2, F.size("ls")), T.strip), "---")).otherwise(0))
    block = F.filter(F.slice("ls", F.lit(2), F.greatest(F.col("end") - 1, F.lit(0)).cast("int")), lambda x: x.contains(":") & (T.strip(F.substring_index(x, ":", 1)) != ""))
    pairs = F.transform(block, lambda x: F.struct(F.lower(T.strip(F.substring_index(x, ":", 1))).alias("k"), F.regexp_replace(T.strip(F.substring(x, F.locate(":", x) + 1, F.length(x))), "^['\"]+|['\"]+$", "").alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    closed = F.col("end") > 0
    body = F.array_join(F.slice("ls", (F.col("end") + 2).cast("int"), F.size("ls")), "\n")
    return out.withColumns({"meta": F.when(closed, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>")), "body": F.when(closed, body).otherwise(F.col("markdown"))}).drop("ls", "end")


_PAGE = re.compile(P.PAGE_COMMENT.replace(r"\p{Nd}", r"\d"))
_FENCE = re.compile(r"^:::\s*(\w+)?\s*$")
_KINDS = [
    (re.compile(P.MD_NOTE), lambda m: ("footnote", m[2].strip(), m[1])),
    (re.compile(P.SCAN), lambda m: ("img", m[1].strip(), "")),
    (re.compile(r"^(#{1,6})\s+(.*)$"), lambda m: (f"h{min(3, len(m[1]))}", m[2].strip(), "")),
    (re.compile(P.MD_BULLET), lambda m: ("ul", m[1].strip(), "")),
    (re.compile(P.MD_ORDERED), lambda m: ("ol", m[1].strip(), "")),
]


def parse(markdown: str) -> tuple[list[tuple[int, str, str, str]], list[str]]:
    """(page_no, kind, text, note_id) items of a document, and warnings."""
    items: list[tuple[int, str, str, str]] = []
    warnings: list[str] = []
    page, fence = 0, ""
    for line in map(str.strip, markdown.split("\n")):
        if fence:
            if line == ":::":
                fence = ""
            elif line:
                items.append((page, fence, line, ""))
            continue
        if not line:
            continue
        if m := _PAGE.match(line):
            page = int(m[1])
        elif m := _FENCE.match(line):
            if m[1] in FENCED:
                fence = m[1]
            elif m[1] is None:
                warnings.append("stray fence")
            else:
                warnings.append(f"unknown fence {m[1]}")
                items.append((page, "p", line, ""))
        elif line[0] == "\\":
            items.append((page, "p", line[1:].strip(), ""))
        else:
            kind = next((make(m) for pattern, make in _KINDS if (m := pattern.match(line))), ("p", line, ""))
            items.append((page, *kind))
    if fence:
        warnings.append(f"unclosed fence {fence}")
    return [(p, k, t if k == "img" else t.replace("\\[^", "[^"), i) for p, k, t, i in items], warnings


ITEMS = "item_no int, page_no int, kind string, text string, note_id string"
_ITEM_TYPE = StructType([StructField("item_no", IntegerType()), StructField("page_no", IntegerType()), StructField("kind", StringType()), StructField("text", StringType()), StructField("note_id", StringType())])


def parse_books(docs: DataFrame) -> DataFrame:
    """(book_id, item_no, page_no, kind, text, note_id) of (book_id, markdown)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for book, text in zip(rows["book_id"], rows["markdown"]):
                items = parse(text or "")[0]
                yield pd.DataFrame([(book, i, *x) for i, x in enumerate(items)], columns=["book_id", "item_no", "page_no", "kind", "text", "note_id"])

    kind = docs.schema["book_id"].dataType.simpleString()
    return docs.select("book_id", "markdown").mapInPandas(run, f"book_id {kind}, {ITEMS}")


def parse_warnings(docs: DataFrame) -> DataFrame:
    """(book_id, warning) of (book_id, markdown) [X04]."""

    @F.pandas_udf("array<string>")
    def said(text: pd.Series) -> pd.Series:
        return text.map(lambda t: parse(t or "")[1])

    return docs.select("book_id", F.explode(said("markdown")).alias("warning"))


@F.udtf(returnType=_ITEM_TYPE)
class ParseMarkdown:
    """The parser as a table function: SELECT * FROM parse_markdown(text)."""

    def eval(self, markdown: str):  # noqa: ANN201
        for i, item in enumerate(parse(markdown or "")[0]):
            yield i, *item
