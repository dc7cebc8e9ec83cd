"""Line dedup in DataFrame functions alone.

A line's key is the line without ASCII white space at its ends and with A-Z
folded. Keys of at least ``min_chars`` code points held by at least
``min_docs`` documents lose all their lines but those of the largest doc_id.

128-bit key hashes are range-partitioned together with a salt of the document,
sorted by document and position, and the first occurrences of every run are
streamed: at most ``min_docs`` documents of each run are needed to know whether
the key is frequent and who keeps it. What goes back to the documents is a
compressed bitmap: the 64-line words in which some line is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import WHITE, shuffle_partitions, store

#: Runs, at least, into which a key's documents are dealt, so that no key is sorted or joined in one task.
SALTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z folded and nothing else."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    """The text split at \\n; null or empty gives one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_dropped, words) of the documents that lose lines; words: array of (word, keep).

    Bit i of ``keep`` is line 64 * word + i; words not listed keep every line.
    A null doc_id counts as one document, smaller than all others. Rows that
    share a doc_id are one document for the count, and each gets its own
    bitmap; equal rows get one between them.
    """
    n = shuffle_partitions(docs.sparkSession)
    lines = docs.select(F.col("doc_id").cast("long"), _row(F.col("text")).alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    keyed = store(keyed.select("doc_id", "text_hash", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")))

    salted = keyed.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(max(SALTS, n))).cast("int"))
    ranged = salted.repartitionByRange(n, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc_nulls_last("doc_id"), "pos")
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc_nulls_last("doc_id"), "pos")
    before = F.lag("doc_id").over(run)
    first = ranged.withColumn("nth", F.row_number().over(run)).withColumn("opens", (F.col("nth") == 1) | ~F.col("doc_id").eqNullSafe(before))
    first = first.where("opens").withColumn("nth", F.row_number().over(run)).where(F.col("nth") <= min_docs)
    runs = store(first.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("winner")))
    frequent = runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("winner").alias("winner")).where(F.col("n_docs") >= min_docs).select("h1", "h2", "winner")
    # a key goes back to its lines run by run, so that a frequent one is not joined in one task
    there = runs.select("h1", "h2", "salt").join(frequent, ["h1", "h2"])

    lost = salted.join(there, ["h1", "h2", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("winner")))
    per_word = lost.select("doc_id", "text_hash", "pos").distinct().repartition(n, "doc_id", "text_hash")
    per_word = per_word.groupBy("doc_id", "text_hash", (F.col("pos") / 64).cast("int").alias("word")).agg(F.count("*").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("drop"))
    return per_word.groupBy("doc_id", "text_hash").agg(F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("keep")))).alias("words"))


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): every row of ``docs`` whole as a struct, the lines that stay joined by \\n, and the counts.

    Columns of any name can stand in ``row``.
    """
    marks = bitmaps.select("doc_id", "text_hash", "words", "n_dropped")
    mine = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _row(F.col("text")).alias("hash"), F.col("text").alias("t"))
    out = mine.join(marks, (mine["hash"] == marks["text_hash"]) & mine["id"].eqNullSafe(marks["doc_id"]), "left")
    lines = lines_of(F.col("t"))
    words = F.map_from_entries("words")
    kept = F.filter(lines, lambda line, i: F.getbit(F.coalesce(F.try_element_at(words, (i / 64).cast("int")), F.lit(-1).cast("long")), i % 64) == 1)
    text = F.when(F.col("words").isNull(), F.coalesce("t", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return out.select("row", text.alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row; see ``keep_bitmaps`` for nulls and repeated rows."""
    mine = docs.select("doc_id", "text")
    out = with_kept_text(mine, keep_bitmaps(mine, min_chars, min_docs))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def without_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` reduced to the lines that stay; null texts stay null and other columns as they are."""
    marked = with_kept_text(docs, keep_bitmaps(docs, min_chars, min_docs))
    new = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    return marked.select(*(new.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
