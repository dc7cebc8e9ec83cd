"""Chapters, volumes and note relocation [A12, A13, W10-W15, W17, J05, J09, J12, O05, O06]."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow import params as P
from quireflow.functions import text as T


def break_levels(items: DataFrame) -> DataFrame:
    """(book_id, level): the shallowest heading level where it occurs twice or more, else null [A13]."""
    level = F.when(F.col("kind").isin("h1", "h2", "h3"), F.substring("kind", 2, 1).cast("int"))
    seen = items.select("book_id", level.alias("level"))
    n = seen.groupBy("book_id", "level").agg(F.count("*").alias("n"))
    return n.groupBy("book_id").agg(F.min(F.when(F.col("level").isNotNull(), F.struct("level", "n"))).alias("m")).select("book_id", F.when(F.col("m.n") >= 2, F.col("m.level")).alias("level"))


def chaptered(items: DataFrame, split_every: int = 10) -> DataFrame:
    """Items (book_id, item_no, page_no, kind, text, note_id) with chapter_no and elem_no; adjoining break headings are one [W10-W12].

    A chapter opens at the first of a run of adjoining break-level headings, or,
    in books without enough headings, every ``split_every`` page groups.
    """
    order = Window.partitionBy("book_id").orderBy("item_no")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    out = items.join(break_levels(items), "book_id", "left")
    breaks = F.coalesce((F.col("kind") == F.concat(F.lit("h"), F.col("level"))), F.lit(False))
    out = out.withColumn("breaks", breaks).withColumn("opens", F.col("breaks") & ~F.coalesce(F.lag("breaks").over(order), F.lit(False)))
    out = out.withColumn("new_group", F.coalesce(F.col("page_no") != F.lag("page_no").over(order), F.lit(True)))
    out = out.withColumns({"by_heading": F.sum(F.col("opens").cast("int")).over(until), "group_no": F.sum(F.col("new_group").cast("int")).over(until) - 1})
    raw = F.when(F.col("level").isNotNull(), F.col("by_heading")).otherwise(F.floor(F.col("group_no") / max(1, split_every)))
    out = out.withColumn("raw", raw)
    out = out.withColumn("chapter_no", (F.dense_rank().over(Window.partitionBy("book_id").orderBy("raw")) - 1).cast("int"))
    # headings that follow a break heading at once are joined to it
    run = F.when(F.col("breaks"), F.sum((~F.col("breaks")).cast("int")).over(until))
    out = out.withColumn("run", run)
    heads = out.where("breaks").groupBy("book_id", "run", "chapter_no").agg(F.min("item_no").alias("item_no"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_no", "text"))), lambda x: x["text"]), " ").alias("merged"))
    out = out.where("not breaks or opens").join(heads.select("book_id", "item_no", "merged"), ["book_id", "item_no"], "left")
    out = out.withColumn("text", F.coalesce(T.strip(F.col("merged")), "text"))
    return out.select("book_id", "chapter_no", (F.row_number().over(Window.partitionBy("book_id", "chapter_no").orderBy("item_no")) - 1).alias("elem_no"), "page_no", "kind", "text", "note_id", F.col("opens").alias("is_title"))


def relocated(elements: DataFrame) -> DataFrame:
    """Note definitions moved behind the chapter that first refers to them [J09]; notes nothing refers to stay."""
    refs = elements.where("kind not in ('footnote', 'img')").select("book_id", "chapter_no", "elem_no", F.explode(F.regexp_extract_all("text", F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1))).alias("note_id"))
    home = refs.groupBy("book_id", "note_id").agg(F.min_by("chapter_no", F.struct("chapter_no", "elem_no")).alias("home"))
    out = elements.join(home, ["book_id", "note_id"], "left").withColumn("moved", (F.col("kind") == "footnote") & F.col("home").isNotNull() & (F.col("home") != F.col("chapter_no")))
    order = Window.partitionBy("book_id", "target").orderBy(F.col("moved").cast("int"), "chapter_no", "elem_no")
    out = out.withColumn("target", F.when(F.col("moved"), F.col("home")).otherwise(F.col("chapter_no"))).withColumn("elem_no", F.row_number().over(order) - 1)
    return out.select("book_id", F.col("target").alias("chapter_no"), "elem_no", "page_no", "kind", "text", "note_id", "is_title")


def chapters(elements: DataFrame, prefix: str = "فصل ") -> DataFrame:
    """(book_id, chapter_no, title, weight, n_elements) with default titles by position [A12, W15]."""
    out = elements.groupBy("book_id", "chapter_no").agg(F.max(F.when(F.col("is_title"), F.coalesce(F.nullif(T.clean_heading(F.col("text")), F.lit("")), "text"))).alias("title"), F.sum(weight(F.col("kind"), F.col("text"))).alias("weight"), F.count("*").alias("n_elements"))
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_no"))
    return out.withColumn("title", F.coalesce(F.nullif(T.strip(F.col("title")), F.lit("")), F.concat(F.lit(prefix), number)))


def weight(kind: Column, text: Column) -> Column:
    """Approximate size of an element [A12]."""
    return F.when(kind == "img", P.IMAGE_WEIGHT).otherwise(F.char_length(F.coalesce(text, F.lit("")))).cast("long")


def chunk_numbers(weights: list[float], parts: int) -> list[int]:
    """The chunk of every item: a new one begins once the running weight and half the item reach an equal share of the rest [W13]."""
    out, number, current, rest, left, some = [], 0, 0.0, float(sum(weights)), max(1, parts), False
    for w in weights:
        if some and left > 1 and current + w / 2 >= rest / left:
            rest, left, number, current = rest - current, left - 1, number + 1, 0.0
        out.append(number)
        current, some = current + w, True
    return out


def volumes(chapters_: DataFrame, parts: int) -> DataFrame:
    """Chapters with volume_no [W13]; a book's weights are one small array."""

    @F.pandas_udf("array<int>")
    def numbers(weights: pd.Series) -> pd.Series:
        return weights.map(lambda w: chunk_numbers([float(x) for x in w], parts))

    books = chapters_.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("chapter_no", "weight"))).alias("c"))
    books = books.select("book_id", "c", numbers(F.transform("c", lambda x: x["weight"])).alias("v"))
    at = books.select("book_id", F.explode(F.arrays_zip("c", "v")).alias("z")).select("book_id", F.col("z.c.chapter_no").alias("chapter_no"), F.col("z.v").alias("volume_no"))
    return chapters_.join(at, ["book_id", "chapter_no"])


def split_giants(elements: DataFrame, most: int = P.MAX_CHAPTER_WEIGHT, target: int = P.TARGET_CHAPTER_WEIGHT) -> DataFrame:
    """Elements with part_no: chapters over ``most`` with more than 3 elements are cut into round(weight / target) parts, 2 at least [W14]."""

    @F.pandas_udf("array<int>")
    def numbers(weights: pd.Series) -> pd.Series:
        return weights.map(lambda w: chunk_numbers([float(x) for x in w], max(2, round(sum(map(float, w)) / target))))

    w = elements.select("book_id", "chapter_no", "elem_no", weight(F.col("kind"), F.col("text")).alias("weight"))
    big = w.groupBy("book_id", "chapter_no").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).where((F.col("total") > most) & (F.col("n") > 3)).select("book_id", "chapter_no")
    arrays = w.join(big, ["book_id", "chapter_no"], "left_semi").groupBy("book_id", "chapter_no").agg(F.sort_array(F.collect_list(F.struct("elem_no", "weight"))).alias("e"))
    arrays = arrays.select("book_id", "chapter_no", "e", numbers(F.transform("e", lambda x: x["weight"])).alias("v"))
    at = arrays.select("book_id", "chapter_no", F.explode(F.arrays_zip("e", "v")).alias("z")).select("book_id", "chapter_no", F.col("z.e.elem_no").alias("elem_no"), F.col("z.v").alias("part_no"))
    return elements.join(at, ["book_id", "chapter_no", "elem_no"], "left").withColumn("part_no", F.coalesce("part_no", F.lit(0)))


def with_split_giants(elements: DataFrame, chapters_: DataFrame, most: int = P.MAX_CHAPTER_WEIGHT, target: int = P.TARGET_CHAPTER_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """Elements and chapters renumbered after giant chapters are cut [W14]: the k-th part of a chapter, from the second on, has `` (k)`` behind its title."""
    parts = split_giants(elements, most, target)
    order = Window.partitionBy("book_id").orderBy("chapter_no", "part_no")
    numbers = parts.groupBy("book_id", "chapter_no", "part_no").agg(F.sum(weight(F.col("kind"), F.col("text"))).alias("weight"), F.count("*").alias("n_elements"))
    numbers = numbers.withColumn("new_no", (F.row_number().over(order) - 1).cast("int"))
    title = F.when(F.col("part_no") == 0, F.col("title")).otherwise(F.concat("title", F.lit(" ("), F.col("part_no") + 1, F.lit(")")))
    heads = numbers.join(chapters_.select("book_id", "chapter_no", "title"), ["book_id", "chapter_no"])
    heads = heads.select("book_id", F.col("new_no").alias("chapter_no"), title.alias("title"), "weight", "n_elements")
    rows = parts.join(numbers.select("book_id", "chapter_no", "part_no", "new_no"), ["book_id", "chapter_no", "part_no"])
    nth = F.row_number().over(Window.partitionBy("book_id", "new_no").orderBy("elem_no")) - 1
    rows = rows.withColumn("elem_no", nth).drop("part_no", "chapter_no").withColumnRenamed("new_no", "chapter_no")
    return rows, heads


#: What a book without any text says; fixed value.
NO_TEXT = "(لم يُتعرف على نص)"


def with_placeholders(elements: DataFrame, books: DataFrame) -> DataFrame:
    """``elements`` and one paragraph in one chapter for each of the books (book_id) that has none, so that no book is lost [C06]."""
    empty = books.select("book_id").join(elements.select("book_id"), "book_id", "left_anti")
    rows = empty.select("book_id", F.lit(0).alias("chapter_no"), F.lit(0).alias("elem_no"), F.lit(0).alias("page_no"), F.lit("p").alias("kind"), F.lit(NO_TEXT).alias("text"), F.lit("").alias("note_id"), F.lit(False).alias("is_title"))
    return elements.unionByName(rows.select(*elements.columns))


def references(elements: DataFrame) -> DataFrame:
    """(book_id, chapter_no, elem_no, pos, note_id, resolved, is_first) of every reference in the text [J05]: found notes of the chapter, the first citation of each."""
    notes = elements.where("kind = 'footnote'").select("book_id", "chapter_no", "note_id").distinct().withColumn("resolved", F.lit(True))
    refs = elements.where("kind not in ('footnote', 'img')").select("book_id", "chapter_no", "elem_no", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1))).alias("pos", "note_id"))
    first = F.row_number().over(Window.partitionBy("book_id", "chapter_no", "note_id").orderBy("elem_no", "pos")) == 1
    return refs.join(notes, ["book_id", "chapter_no", "note_id"], "left").select("book_id", "chapter_no", "elem_no", "pos", "note_id", F.coalesce("resolved", F.lit(False)).alias("resolved"), first.alias("is_first"))


def note_numbers(elements: DataFrame, language: Column | None = None) -> DataFrame:
    """(book_id, chapter_no, elem_no, note_id, number, shown): display numbers of a chapter's notes [W17]."""
    n = F.row_number().over(Window.partitionBy("book_id", "chapter_no").orderBy("elem_no"))
    shown = F.when((language if language is not None else F.lit("ar")).startswith("ar"), T.arabic_digits(n)).otherwise(n.cast("string"))
    return elements.where("kind = 'footnote'").select("book_id", "chapter_no", "elem_no", "note_id", n.alias("number"), shown.alias("shown"))


def covers(elements: DataFrame) -> DataFrame:
    """(book_id, page_no) of the first scan, if it is on page 0 or 1 [O05]."""
    return elements.where("kind = 'img'").groupBy("book_id").agg(F.min("page_no").alias("page_no")).where("page_no <= 1")


def toc_pages(pages: DataFrame, every: int = 20) -> DataFrame:
    """Every k-th page as a table-of-contents entry [O06]."""
    return pages.where(F.col("page_no") % every == 0)
