"""Lines and their filters [S15, F02-F07, C02, C03, A06, A07]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow import params as P
from quireflow.functions import text as T
from quireflow.stages import stage

PAGE = ("book_id", "page_no")
#: Rows up to which a book's pages are numbered by one window over its keys.
FEW_PAGES = 1_000_000


def page_numbers(docs: DataFrame, book: str = "source", order: str = "doc_id") -> DataFrame:
    """(book_id, at, page_no): the rank of every document in its book by ``order``, from 0.

    Ranks are made from the two narrow columns alone, and no text is moved. Beyond
    ``FEW_PAGES`` rows this goes by range: rows are counted range by range and
    numbered inside each, so that no book is sorted in one task; the result is
    the same. Documents equal in both columns share a page.
    """
    keys = docs.select(F.col(book).alias("book_id"), F.col(order).alias("at")).distinct()
    if docs.select(order).limit(FEW_PAGES + 1).count() <= FEW_PAGES:
        return keys.select("book_id", "at", (F.row_number().over(Window.partitionBy("book_id").orderBy("at")) - 1).alias("page_no"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stage(keys.repartitionByRange(n, "book_id", "at").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("book_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("book_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("book_id").alias("b"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("book_id", "part").orderBy("at"))
    ranked = parts.withColumn("nth", nth).join(offsets, F.col("book_id").eqNullSafe(F.col("b")) & (F.col("part") == F.col("p")))
    return ranked.select("book_id", "at", (F.col("before") + F.col("nth") - 1).cast("int").alias("page_no"))


def document_pages(docs: DataFrame, book: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(book_id, page_no, ``order``, text): a document as a page of the book ``book``, ranked by ``order``; a null text is empty."""
    numbers = page_numbers(docs, book, order).select(F.col("book_id").alias("b"), F.col("at").alias("a"), "page_no")
    pages = docs.select(F.col(book).alias("book_id"), F.col(order), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return pages.join(numbers, F.col("book_id").eqNullSafe(F.col("b")) & F.col(order).eqNullSafe(F.col("a"))).select("book_id", "page_no", order, "text")


def document_lines(docs: DataFrame, book: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """(book_id, page_no, line_no, text): the lines of ``document_pages``."""
    return document_pages(docs, book, order, text).select("book_id", "page_no", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def visible(lines: DataFrame) -> DataFrame:
    """Lines with something to see [F02]."""
    return lines.where(T.strip(F.col("text")) != "")


def edges(lines: DataFrame) -> DataFrame:
    """Visible lines with column ``edge``: the first or last two of their page [F07]."""
    up, down = Window.partitionBy(*PAGE).orderBy("line_no"), Window.partitionBy(*PAGE).orderBy(F.desc("line_no"))
    return visible(lines).withColumn("edge", (F.row_number().over(up) <= 2) | (F.row_number().over(down) <= 2))


def dropped(norm: Column, edge: Column, script: P.Script = P.ARABIC, patterns: list[str] | None = None) -> Column:
    """Watermark, page number or junk [F03 without the repeated lines]."""
    return T.watermark(norm, patterns) | T.page_number(norm) | T.junk(norm, edge, script)


def flagged(lines: DataFrame, script: P.Script = P.ARABIC, patterns: list[str] | None = None, compose: bool = True) -> DataFrame:
    """``edges`` with the normalized text and the three drop flags."""
    out = edges(lines).withColumn("norm", T.normalize(F.col("text"), True, compose))
    return out.withColumns({"is_watermark": T.watermark(F.col("norm"), patterns), "is_page_number": T.page_number(F.col("norm")), "is_junk": T.junk(F.col("norm"), F.col("edge"), script)}).withColumn("dropped", F.col("is_watermark") | F.col("is_page_number") | F.col("is_junk"))


def char_counts(flags: DataFrame) -> DataFrame:
    """(book_id, page_no, kept_chars, dropped_chars) of flagged lines, counted on their normalized text [A07]."""
    n = T.coverage_of(F.col("norm"))
    return flags.groupBy(*PAGE).agg(F.sum(F.when(F.col("dropped"), 0).otherwise(n)).alias("kept_chars"), F.sum(F.when(F.col("dropped"), n).otherwise(0)).alias("dropped_chars"))


def lines_of_words(words: DataFrame) -> DataFrame:
    """Recognised words (block, par, line keys) as lines with their box and confidence [A02, A06]."""
    keys = ["book_id", "page_no", "block_no", "par_no", "row_no"]
    seen = words.where(T.strip(F.col("text")) != "")
    order = F.sort_array(F.collect_list(F.struct("word_no", "text")))
    out = seen.groupBy(*keys).agg(F.array_join(F.transform(order, lambda w: w["text"]), " ").alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0)).alias("conf"))
    number = Window.partitionBy("book_id", "page_no").orderBy("block_no", "par_no", "row_no")
    return out.withColumn("line_no", F.row_number().over(number) - 1).select("book_id", "page_no", "line_no", "text", "x", "y", "w", "h", "conf")


def page_confidence(words: DataFrame) -> DataFrame:
    """(book_id, page_no, mean_conf, word_count) of recognised words [A02]."""
    return words.groupBy(*PAGE).agg(F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0)).alias("mean_conf"), F.count_if(T.strip(F.col("text")) != "").alias("word_count"))


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines numbered top to bottom and right to left [O02]."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y", F.desc("x"))) - 1)


def boxed_chars(chars: DataFrame, rects: DataFrame) -> DataFrame:
    """(book_id, page_no, rect_no, size, bold): characters in rectangles by their centre, with the median size [J07, A08, S06].

    Characters (x, y, w, h, size, weight) and rectangles (x, y, w, h) meet on the page first.
    """
    c = chars.where("size > 1.0").select(*PAGE, (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), "size", "weight")
    hit = c.join(rects.select(*PAGE, "rect_no", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh")), list(PAGE)).where("cx between rx and rx + rw and cy between ry and ry + rh")
    return hit.groupBy(*PAGE, "rect_no").agg(F.median("size").alias("size"), F.coalesce(F.avg(F.when(F.col("weight") > 0, (F.col("weight") >= 600).cast("int"))), F.lit(0.0)).alias("bold"))


def split_hemistichs(words: DataFrame) -> DataFrame:
    """(book_id, page_no, line_no, first, second) of lines with a wide central gap [W18]: at least 4 words, gap >= 0.12 of the width, centre in 0.3 to 0.7."""
    key = ["book_id", "page_no", "line_no"]
    order = Window.partitionBy(*key).orderBy("x", "word_no")
    w = words.where(T.strip(F.col("text")) != "").withColumn("gap", F.lead("x").over(order) - (F.col("x") + F.col("w"))).withColumn("nth", F.row_number().over(order))
    mine = w.groupBy(*key).agg(F.count("*").alias("n"), F.min("x").alias("left"), F.max_by(F.col("x") + F.col("w"), "nth").alias("right"), F.max_by(F.struct("nth", "gap", (F.col("x") + F.col("w")).alias("edge")), F.struct(F.coalesce("gap", F.lit(0)), -F.col("nth"))).alias("best"), F.sort_array(F.collect_list(F.struct("nth", "text"))).alias("t"))
    width = F.greatest(F.lit(1), F.col("right") - F.col("left"))
    centre = (F.col("best.edge") + F.col("best.gap") / 2 - F.col("left")) / width
    ok = (F.col("n") >= 4) & (F.col("best.gap") > 0) & (F.col("best.gap") >= 0.12 * width) & centre.between(0.3, 0.7)
    texts = F.transform("t", lambda x: x["text"])
    return mine.where(ok).select(*key, F.array_join(F.slice(texts, F.col("best.nth") + 1, F.col("n").cast("int")), " ").alias("first"), F.array_join(F.slice(texts, F.lit(1), F.col("best.nth")), " ").alias("second"))
