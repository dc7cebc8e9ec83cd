"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Fixed base rules come first. Beyond them, cutoffs on a few signals are chosen
per stratum from labelled documents. One half of the labels nominates: of every
signal the cutoffs that catch bad documents well more often than good ones.
They make up levels, each the strictest nominated cutoffs so far of all signals
together, so that a level rejects what the one before it does. The other half
certifies: a level passes when an exact binomial bound says that all its
cutoffs together falsely reject at most the allowed rate, and levels are tested
from the mildest until one fails (fixed sequence), with the error rate split
over the strata that have nominees (Bonferroni).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm.common import store

#: Words of the word rule; patterns of the contract, fixed values.
WORD = r"[^\x20\x09-\x0D]+"
WHITE_CHAR = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

#: Cutoffs of every signal, mildest first; a document is rejected when the signal is larger.
SIGNALS: dict[str, list[float]] = {
    "symbol_rate": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02],
    "upper_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25],
    "repeat_rate": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15],
    "dup_line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4],
    "mark_rate": [2.0, 1.5, 1.0, 0.75, 0.5, 0.4],
}


@dataclass(frozen=True)
class Risk:
    """``max_rate`` of good documents may be rejected in a stratum by all signals together, with confidence 1 - ``error``.

    A cutoff is nominated where it catches bad documents at more than ``lift``
    times the rate of good ones. With four strata, 86 good documents in the
    certifying half, none rejected, suffice at these rates.
    """

    max_rate: float = 0.05
    error: float = 0.05
    lift: float = 2.0
    min_words: int = 50
    repeat_percent: int = 50


def measures(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The base measures and signal values of every row, beside doc_id and lang, and with ``whole`` the row as struct ``row``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, none for a null text.
    n_repeat_words counts the words in three-word windows that occur twice or
    more. Windows are compared by position-packed 33-bit hashes first and those
    that collide by 64-bit hashes of the three words.
    """
    text = F.coalesce("text", F.lit(""))
    row = ["row"] if whole else []
    m = docs.select(*([F.struct("*").alias("row")] if whole else []), "doc_id", "lang", text.alias("t"))
    m = m.select(*row, "doc_id", "lang", "t", F.filter(F.split("t", WHITE_CHAR + "+", -1), lambda w: w != "").alias("w"))
    windows = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))

    def window_hash(i: Column) -> Column:
        return F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))

    low, high = F.lit((1 << 31) - 1).cast("long"), F.lit(-(1 << 31)).cast("long")
    packed = F.sort_array(F.transform(windows, lambda i: window_hash(i).bitwiseAND(high).bitwiseOR(i.cast("long"))))
    # bound once by a one-element transform, as a lambda would evaluate it for every element
    suspects = F.get(F.transform(F.array(packed), lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1).bitwiseAND(high) == x.bitwiseAND(high)) | (F.get(p, k + 1).bitwiseAND(high) == x.bitwiseAND(high)))), F.lit(0))
    m = m.withColumn("suspects", suspects)
    full = F.array_sort(F.transform("suspects", lambda x: F.struct(window_hash(x.bitwiseAND(low).cast("int")).alias("h"), x.bitwiseAND(low).cast("int").alias("i"))))
    twice = F.get(F.transform(F.array(full), lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))), F.lit(0))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")))["n"]
    lines = F.filter(F.split("t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    m = m.withColumn("n_repeat_words", F.when(F.size("suspects") > 0, covered).otherwise(0).cast("long")).withColumn("lines", lines)
    length = F.char_length("t")
    m = m.select(
        *row,
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        (length - F.regexp_count("t", F.lit(WHITE_CHAR))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").alias("n_lines"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("t", F.lit("!")).alias("n_marks"),
    )
    words, chars, rows = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    rates = {"symbol_rate": F.col("n_symbols") / chars, "upper_rate": F.col("n_upper") / chars, "repeat_rate": F.col("n_repeat_words") / words, "dup_line_rate": F.col("n_dup_lines") / rows, "mark_rate": F.col("n_marks") / words}
    return m.withColumns(rates)


def base_failed(risk: Risk) -> Column:
    return (F.col("n_words") < risk.min_words) | (100 * F.col("n_repeat_words") > risk.repeat_percent * F.col("n_words"))


def log_binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """log P[Bin(n, p) <= k], summed term by term in logarithms."""
    first = n * F.log1p(-p)
    step = F.log(p) - F.log1p(-p)
    state = F.struct(first.alias("term"), first.alias("total"))

    def add(a: Column, j: Column) -> Column:
        term = a["term"] + F.log((n - j + 1) / j) + step
        high = F.greatest(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(a["total"], term) - high))).alias("total"))

    upto = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(upto, state, add)["total"]


#: Levels of the fixed sequence: ranks of the longest list of cutoffs.
LEVELS = max(map(len, SIGNALS.values()))


def over_any(risk_columns: str = "max_") -> Column:
    """Whether some signal is over its cutoff column; a null cutoff rejects nothing."""
    over = F.lit(False)
    for s in SIGNALS:
        over = over | F.coalesce(F.col(s) > F.col(f"{risk_columns}{s}"), F.lit(False))
    return over


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    """(stratum, max_<signal>...): the cutoffs of the strictest certified level; strata without one are absent.

    Good documents are labelled quality 1, bad ones 0; other or null labels and
    labels without a document are ignored, and a document labelled twice counts
    once a label. Documents that fail the base rules need no cutoff and are
    left out.
    """
    said = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    known = measured.where(~base_failed(risk)).select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), *SIGNALS).join(said, "doc_id")
    known = store(known.withColumn("holdout", F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8"))

    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(r).alias("rank"), F.lit(float(c)).alias("cutoff"), (F.col(s) > c).cast("int").alias("out")) for s, cs in SIGNALS.items() for r, c in enumerate(cs))))
    cells = known.where("not holdout").select("stratum", "quality", grid.alias("g")).select("stratum", "quality", "g.*")

    def count(quality: int, value: Column) -> Column:
        return F.sum(F.when(F.col("quality") == quality, value).otherwise(0))

    out, one = F.col("out"), F.lit(1)
    cells = cells.groupBy("stratum", "signal", "rank", "cutoff").agg(count(1, out).alias("good"), count(1, one).alias("good_n"), count(0, out).alias("bad"), count(0, one).alias("bad_n"))
    nominated = cells.where(F.col("bad") * F.greatest("good_n", F.lit(1)) > risk.lift * F.col("good") * F.greatest("bad_n", F.lit(1)))
    levels = nominated.select("stratum", "signal", "cutoff", F.explode(F.sequence("rank", F.lit(LEVELS - 1))).alias("level"))
    levels = store(levels.groupBy("stratum", "level").agg(*(F.min(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"max_{s}") for s in SIGNALS)))
    strata = max(1, levels.select("stratum").distinct().count())

    tried = known.where("holdout and quality = 1").join(light(levels), "stratum").groupBy("stratum", "level").agg(F.sum(over_any().cast("int")).alias("k"), F.count("*").alias("n"))
    # at most max_rate * n rejections can pass, which bounds the sum
    passes = F.when(F.col("k") <= risk.max_rate * F.col("n"), log_binomial_cdf(F.col("k"), F.col("n"), F.lit(risk.max_rate)) <= math.log(risk.error / strata)).otherwise(False)
    sequence = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    open_ = tried.withColumn("open", F.min(passes.cast("int")).over(sequence)).where("open = 1")
    return levels.join(open_.groupBy("stratum").agg(F.max("level").alias("level")), ["stratum", "level"]).drop("level")


#: Rows of cutoffs up to which they are broadcast; beyond, they are joined by stratum.
FEW = 100_000


def light(cutoffs: DataFrame) -> DataFrame:
    return F.broadcast(cutoffs) if cutoffs.limit(FEW + 1).count() <= FEW else cutoffs


def judged(measured: DataFrame, labels: DataFrame, risk: Risk) -> DataFrame:
    """``measured``, which is stored, with base_failed and kept."""
    limits = store(certified_cutoffs(measured, labels.select("doc_id", "quality"), risk))
    wide = measured.withColumn("stratum", F.coalesce("lang", F.lit(""))).join(light(limits), "stratum", "left")
    return wide.withColumn("base_failed", base_failed(risk)).withColumn("kept", ~F.col("base_failed") & ~over_any())


def quality_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row.

    kept: not base_failed, and no signal over its stratum's certified cutoff.
    A stratum is a lang (null: one stratum); one without enough labels gets no
    cutoff and keeps whatever passes the base rules. Null or empty texts have
    no words and fail. Rows are judged one by one, repeated ones alike; an
    empty table gives an empty result.
    """
    out = judged(store(measures(docs.select("doc_id", "text", "lang"))), labels, risk)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns; measured once, and stored beside their measures."""
    return judged(store(measures(docs, whole=True)), labels, risk).where("kept").select("row.*")
