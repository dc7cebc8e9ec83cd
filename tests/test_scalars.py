"""Scalar text functions against the values their rules give."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow import params as P
from quireflow.errors import LimitError, OptionError, check_choice, check_limit, page_indices
from quireflow.functions import text as T
from quireflow.operators import chapters, markdown, notes
from quireflow.sources import readers


def value(spark, make, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    assert value(spark, T.normalize, "ﻻ  شيء\t", "كـتـاب", " a\u00a0", None) == ["لا شيء", "كتاب", "a", None]
    assert value(spark, lambda c: T.normalize(c, False), "مَدَّ") == ["مد"]


def test_stable_characters():
    latin = [chr(c) for c in range(256)]
    changed = [c for c in latin if unicodedata.normalize("NFKC", c) != c]
    assert changed == re.findall(T.UNSTABLE_LATIN, "".join(latin))
    stable = "".join(c for c in latin if c not in changed)
    assert unicodedata.normalize("NFKC", stable[::-1]) == stable[::-1]


def test_keys_and_ratios(spark):
    assert value(spark, T.fuzzy_key, "Noor-Book. COM_1", "…") == ["noorbookcom1", ""]
    assert value(spark, T.coverage_chars, "a b\u3000c\n") == [3]
    assert value(spark, T.arabic_ratio, "abc مرحـبا", "123", "نص") == [pytest.approx(5 / 8), 0.0, 1.0]
    assert value(spark, T.bad_glyph_ratio, "ab\ue000\ufffd", "", " ") == [0.5, 0.0, 0.0]


def test_corrupted(spark):
    healthy = "كلمة صحيحة " * 30
    assert value(spark, T.corrupted, healthy, healthy + " ل شيء", "ل شيء " * 5, "السإلمية في بإ " * 30) == [False, True, False, True]


def test_lines(spark):
    assert value(spark, T.page_number, "- 12 -", "(٣)", "12345", "12 a") == [True, True, False, False]
    assert value(spark, T.watermark, "see HTTP://x.y", "noor book", "kotob . has . it", "plain") == [True, True, True, False]
    assert value(spark, lambda c: T.watermark(c, ["draft"]), "a DRAFT") == [True]
    assert value(spark, lambda c: T.junk(c, F.lit(False)), "* * *", "ab", "abcdef", "نص") == [True, True, False, False]
    assert value(spark, lambda c: T.junk(c, F.lit(True)), "abcdef", "نص", "هذا سطر عربي طويل") == [True, True, False]
    assert value(spark, lambda c: T.junk(c, F.lit(True), P.LATIN), "abcdef", "* *") == [False, True]


def test_items_headings_verses(spark):
    kinds = [r and tuple(r) for r in value(spark, T.list_item, "1. one", "٢) اثنان", "• dot", "- dash", "1.x")]
    assert kinds == [("ol", "one"), ("ol", "اثنان"), ("ul", "dot"), None, None]
    assert value(spark, T.heading_text, "الفصل الأول", "كلام", "باب " + "كلمة " * 9) == [True, False, False]
    assert value(spark, T.clean_heading, '١" - ا لإسلام |', "  الفصل  الأول -") == ["الإسلام", "الفصل الأول"]
    assert value(spark, T.rhyme, "أحزانِ!", "بلدان 12", "x") == ["ان", "ان", ""]
    assert value(spark, T.verse_candidate, "one two", "one two three", "one two three.") == [False, True, False]
    assert value(spark, T.verse_text, "شطر أول | شطر ثان") == ["شطر أول\u2003\u2003شطر ثان"]


def test_joining(spark):
    df = spark.createDataFrame([(["exam-", "ple done."],), (["a ", "", " b-", "C"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(T.join_lines(F.col("t"))).collect()] == ["example done.", "a b- C", ""]


def test_quotes(spark):
    got = [tuple(r) for r in value(spark, lambda c: T.mark_quote(c, F.lit(True)), "«* نص طويل جدا هنا »", "بلا قوس", "قال «قصير»")]
    assert got == [("﴿نص طويل جدا هنا﴾", True), ("بلا قوس", False), ("قال «قصير»", False)]
    assert value(spark, T.attributed_quote, " «إن الله» كريم* ") == ["﴿إن الله كريم﴾"]


def test_escapes(spark):
    assert value(spark, T.escape_inline, "a [^1] b [^p1-2]", "x") == ["a \\[^1] b [^p1-2]", "x"]
    assert value(spark, T.escape_start, "# a", "1. b", "c", "\\d") == ["\\# a", "\\1. b", "c", "\\\\d"]
    assert value(spark, T.xml_escape, "<a&b>") == ["&lt;a&amp;b&gt;"]


def test_names(spark):
    assert value(spark, T.title_of_path, "/a/Noor-Book.com كتاب - .pdf", "/x/.pdf") == ["كتاب", ".pdf"]
    assert value(spark, T.language_tag, " ar-EG ", "a b", "") == ["ar-EG", "und", "und"]
    assert value(spark, T.arabic_digits, "120") == ["١٢٠"]


def test_options():
    assert page_indices("1-2,9-10", 10) == [0, 1, 8, 9] and page_indices(None, 2) == [0, 1]
    for bad in ("0-1", "5", ",", "x"):
        with pytest.raises(OptionError):
            page_indices(bad, 4)
    with pytest.raises(LimitError):
        check_limit("pages", 2, 1)
    with pytest.raises(OptionError):
        check_choice("mode", "x", ["a"])
    assert readers.device("none")[2] == 0
    with pytest.raises(OptionError):
        readers.device("?")


def test_references_are_rewritten_only_when_unique():
    assert notes.rewrite(["see (١) here", "and [2]"], ["١", "2"], ["p1-1", "p1-2"]) == ["see [^p1-1] here", "and [^p1-2]"]
    assert notes.rewrite(["(1) and [1]"], ["1"], ["p1-1"]) == ["(1) and [1]"]


def test_volumes():
    assert chapters.chunk_numbers([100, 100, 1000, 100, 100], 3) == [0, 0, 1, 2, 2]
    assert chapters.chunk_numbers([1, 1, 1], 1) == [0, 0, 0] and chapters.chunk_numbers([], 3) == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=30), st.integers(1, 6))
def test_volumes_are_consecutive(weights, parts):
    v = chapters.chunk_numbers(weights, parts)
    assert v[0] == 0 and all(b - a in (0, 1) for a, b in zip(v, v[1:])) and v[-1] < parts


def test_parse():
    text = "<!-- page:3 -->\n# A\n#### B\n- u\n٢) o\n[^p4-1]: note\n![scan](a.png)\n:::verse\n<!-- page:9 -->\nline\n:::\n:::\n:::box\n\\# lit \\[^1]\r\nlast\n:::quran\nopen"
    items, warnings = markdown.parse(text)
    assert items == [(3, "h1", "A", ""), (3, "h3", "B", ""), (3, "ul", "u", ""), (3, "ol", "o", ""), (3, "footnote", "note", "p4-1"), (3, "img", "a.png", ""), (3, "verse", "<!-- page:9 -->", ""), (3, "verse", "line", ""), (3, "p", ":::box", ""), (3, "p", "# lit [^1]", ""), (3, "p", "last", ""), (3, "quran", "open", "")]
    assert warnings == ["stray fence", "unknown fence box", "unclosed fence quran"]
