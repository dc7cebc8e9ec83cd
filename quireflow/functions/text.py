"""Scalar text functions as Column expressions [T01-T24]; Python only where Spark has no equivalent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow import params as P

#: White space as Unicode has it, and U+001C-001F, for a character class; fixed values. Java's (?U) classes are slower.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same characters one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


#: The characters up to U+00FF that composition changes; the others there stay, and none combines with another.
UNSTABLE_LATIN = "[\u00a0\u00a8\u00aa\u00af\u00b2-\u00b5\u00b8-\u00ba\u00bc-\u00be]"


def nfkc(text: Column) -> Column:
    """Compatibility composition (NFKC) by the ICU library that Spark brings, for texts that it can change: none of ASCII and few of Latin ones.

    Spark takes reflection for nondeterministic: use the result as a column, not inside an aggregate or a join condition.
    """
    may = (F.octet_length(text) > F.char_length(text)) & (text.rlike("[^\u0000-\u00ff]") | text.rlike(UNSTABLE_LATIN))
    return F.when(may, F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))).otherwise(text)


def strip(text: Column) -> Column:
    """Without Unicode white space (and U+001C-001F) at both ends."""
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def words_between(text: Column, low: int, high: int) -> Column:
    """Whether ``words`` is in low (1 at least) to high; a longer text is read to its word ``high`` only."""
    return text.rlike(f"\\A[{SPACE}]*+(?:[^{SPACE}]++(?:[{SPACE}]++|\\z)){{{low},{high}}}+\\z")


def ends_terminal(bare: Column) -> Column:
    """Whether the last character of a stripped text is terminal punctuation."""
    return F.right(bare, F.lit(1)).rlike(f"[{P.TERMINAL}]")


def normalize(text: Column, keep_diacritics: bool = True, compose: bool = True) -> Column:
    """Compatibility forms folded, tatweel dropped, blanks squeezed [T01]."""
    out = F.replace(nfkc(text) if compose else text, F.lit(P.TATWEEL), F.lit(""))
    if not keep_diacritics:
        out = F.regexp_replace(out, P.DIACRITICS, "")
    return strip(F.regexp_replace(out, r"[ \t]+", " "))


def fuzzy_key(text: Column, compose: bool = True) -> Column:
    """Letters and digits in lower case [T02]."""
    return F.regexp_replace(F.lower(normalize(text, False, compose)), r"[^\p{L}\p{N}]+", "")


def coverage_chars(text: Column, compose: bool = True) -> Column:
    """Characters that count for coverage [T03]."""
    return coverage_of(nfkc(text) if compose else text)


def coverage_of(norm: Column) -> Column:
    """``coverage_chars`` of a text that is composed already: its characters without tatweel, marks and white space."""
    return F.char_length(F.regexp_replace(norm, f"[{SPACE}{P.TATWEEL}{P.DIACRITICS[1:-1]}]+", "")).cast("long")


def arabic_ratio(text: Column) -> Column:
    """Arabic letters over letters, tatweel in neither; 0 without letters [T04]."""
    letters = F.regexp_count(text, F.lit(rf"(?!{P.TATWEEL})\p{{L}}"))
    arabic = F.regexp_count(text, F.lit(rf"(?!{P.TATWEEL})[\p{{L}}&&\p{{IsArabic}}]"))
    return F.when(letters > 0, arabic / letters).otherwise(F.lit(0.0))


def bad_glyph_ratio(text: Column) -> Column:
    """Replacement and private-use characters over visible ones [T05]."""
    visible = F.char_length(F.regexp_replace(text, f"[{SPACE}]+", ""))
    bad = F.regexp_count(text, F.lit(r"[\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"))
    return F.when(visible > 0, bad / visible).otherwise(F.lit(0.0))


def corrupted(text: Column, layer: P.Layer = P.Layer()) -> Column:
    """Ligature loss in the first characters [T07]; false under the measurable number of words."""
    sample = F.substring(text, 1, layer.sample_chars)
    n = words(sample)
    lam, hamza = F.regexp_count(sample, F.lit("(?U)" + P.LONE_LAM)), F.regexp_count(sample, F.lit(P.MISPLACED_HAMZA))
    return (n >= layer.measurable_words) & ((lam / n > layer.lone_lam) | (hamza / n > layer.misplaced_hamza))


def join_lines(lines: Column) -> Column:
    """Wrapped lines as one text; a hyphen between ASCII letters, the second small, goes [T06]."""
    mark = "\u241e"
    bare = F.filter(F.transform(lines, strip), lambda x: x != "")
    joined = F.array_join(bare, mark)
    joined = F.regexp_replace(joined, f"(?<=[A-Za-z])[-\u2010\u2011]{mark}(?=[a-z])", "")
    return strip(F.replace(joined, F.lit(mark), F.lit(" ")))


def clean_heading(text: Column) -> Column:
    """A heading as a table-of-contents label [T08]."""
    out = F.regexp_replace(text, "(?U)\\b\u0627\\s+\u0644(?=[\u0621-\u064a])", "\u0627\u0644")
    out = F.regexp_replace(out, r"""['"`*_|<>}{\\]+""", " ")
    out = F.regexp_replace(out, f"(?U)^[\\s0-9\u0660-\u0669{P.TATWEEL}\\-\u2013\u2014.,:;)(\u200e\u200f]+", "")
    out = F.regexp_replace(out, r"(?U)\s+", " ")
    return strip(F.regexp_replace(out, f"^[ \\-\u2013\u2014{P.TATWEEL}]+|[ \\-\u2013\u2014{P.TATWEEL}]+$", ""))


def rhyme(text: Column) -> Column:
    """The last two Arabic letters; empty under two [T09]."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), "[\u064b-\u0652\u0670\u0655\u0654]", ""), "[^\u0621-\u064a]+$", "")
    return F.when(F.char_length(bare) >= 2, F.right(bare, F.lit(2))).otherwise("")


def verse_text(text: Column) -> Column:
    """A verse line with its divider as two em spaces [T10]."""
    return F.regexp_replace(strip(text), r"(?U)\s*[|_]+\s*", "\u2003\u2003")


def watermark(text: Column, more: list[str] | None = None) -> Column:
    """Any of the seed or user patterns anywhere [F04, X01, U05]; user patterns are Java regular expressions."""
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in [*P.WATERMARKS, *(more or [])]))


def page_number(text: Column) -> Column:
    """The whole line is a page number [F05]."""
    return text.rlike("(?U)" + P.PAGE_NUMBER)


def own_page_number(text: Column, page_no: Column) -> Column:
    """A page number on the page ``page_no`` (from 0): as ``page_number``, and beyond the digits that allows as many as the page's own number has."""
    digits = F.char_length(F.regexp_extract(text, "(?U)" + P.PAGE_NUMBER.replace("[0-9٠-٩]{1,4}", "([0-9٠-٩]{5,})"), 1))
    return page_number(text) | ((digits > 0) & (digits <= F.char_length((page_no + 1).cast("string"))))


def junk(text: Column, edge: Column, script: P.Script = P.ARABIC) -> Column:
    """Debris and short edge lines [F06]. Without the Arabic tests any letter or digit makes a line text."""
    bare = strip(text)
    n = F.char_length(bare)
    if not script.arabic:
        return (n == 0) | ~bare.rlike(r"[\p{L}\p{N}]")
    arabic = F.regexp_count(bare, F.lit(P.ARABIC_OR_DIGIT))
    return (n == 0) | ((arabic == 0) & (~bare.rlike("[A-Za-z0-9]") | (n <= script.junk_short))) | (edge & ((n <= script.edge_short) | ((n <= script.edge_length) & (arabic / n < script.edge_ratio))))


def verse_candidate(text: Column) -> Column:
    """3 to 16 words, no terminal punctuation [F15]."""
    bare = strip(text)
    return words_between(bare, 3, 16) & ~ends_terminal(bare)


def heading_keyword(text: Column) -> Column:
    """Begins with a heading word."""
    return text.rlike(r"(?U)^\s*(" + "|".join(P.HEADING_WORDS) + ")")


def heading_text(text: Column) -> Column:
    """A short line that begins with a heading word [F16]."""
    return words_between(text, 1, P.HEADING_MAX_WORDS) & heading_keyword(text)


def list_item(text: Column) -> Column:
    """struct(kind, text) of a list item line, null if it is none [T13]; a dash is no bullet."""
    ordered, bullet = "(?U)" + P.LIST_ORDERED, "(?U)" + P.LIST_BULLET

    def item(kind: str, pattern: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), strip(F.regexp_extract(text, pattern, 1)).alias("text"))

    return F.when(text.rlike(ordered), item("ol", ordered)).when(text.rlike(bullet), item("ul", bullet))


def note_label(text: Column) -> Column:
    """The digits of a note marker at the start; empty without one [T15]."""
    parts = [F.regexp_extract(text, "(?U)" + P.NOTE_MARKER, i) for i in (1, 2, 3)]
    return F.concat(*parts)


def note_marked(text: Column) -> Column:
    return text.rlike("(?U)" + P.NOTE_MARKER)


def note_text(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?U)" + P.NOTE_MARKER, ""))


def latin_digits(text: Column) -> Column:
    return F.translate(text, P.ARABIC_DIGITS, P.LATIN_DIGITS)


def arabic_digits(text: Column) -> Column:
    """[T16, W17]"""
    return F.translate(text.cast("string"), P.LATIN_DIGITS, P.ARABIC_DIGITS)


def unterminated(text: Column) -> Column:
    """Not empty and without terminal punctuation at the end."""
    bare = strip(text)
    return (bare != "") & ~ends_terminal(bare)


def quote_share(text: Column) -> Column:
    """Characters in quotation brackets [A17]."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(P.QUOTE_BRACKETS), F.lit(0)), F.lit(0), lambda a, x: a + F.char_length(x))


def mark_quote(text: Column, cue: Column) -> Column:
    """struct(text, dominated): ornate brackets restored near a cue [T11]."""
    changed = F.regexp_replace(text, "[\u00ab\ufd3f](?=[^\u00ab\u00bb\ufd3e\ufd3f]{8,400}[\u00bb\ufd3e])[ *]*([^\u00ab\u00bb\ufd3e\ufd3f]*?)[ *]*[\u00bb\ufd3e]", "\ufd3f$1\ufd3e")
    some = cue & text.rlike(P.QUOTE_BRACKETS)
    return F.struct(F.when(some, changed).otherwise(text).alias("text"), (some & (quote_share(text) >= 0.6 * F.char_length(text))).alias("dominated"))


def attributed_quote(text: Column) -> Column:
    """A paragraph its next line names as a quotation [T12]."""
    bare = strip(F.regexp_replace(strip(text), "^[\u00ab\u00bb*]+|[\u00ab\u00bb*]+$", ""))
    bare = strip(F.regexp_replace(F.regexp_replace(bare, "[\u00ab\u00bb]", " "), r"(?U)\s+", " "))
    return F.concat(F.lit("\ufd3f"), bare, F.lit("\ufd3e"))


def escape_inline(text: Column) -> Column:
    """``[^`` escaped unless it opens a generated reference [T17]."""
    return F.regexp_replace(text, r"\[\^(?!p\p{Nd}+-\p{Nd}+\])", r"\\[^")


def unescape_inline(text: Column) -> Column:
    return F.replace(text, F.lit("\\[^"), F.lit("[^"))


def escape_start(text: Column) -> Column:
    """A paragraph that would read as something else gets a backslash [T18]."""
    return F.when(text.rlike(P.MD_NEEDS_ESCAPE), F.concat(F.lit("\\"), text)).otherwise(text)


def xml_escape(text: Column) -> Column:
    """[T23]"""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def title_of_path(path: Column) -> Column:
    """Title from a file name [T20]."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(stem, r"(?iU)noor-book\.com\s*", ""), "^[ _-]+|[ _-]+$", ""), F.lit("")), stem)


def volume_name(stem: Column, number: Column, total: Column) -> Column:
    """[T21]"""
    return F.when(total == 1, stem).otherwise(F.concat(stem, F.lit(" - "), number.cast("string")))


def language_tag(language: Column) -> Column:
    """A safe tag or ``und`` [T22]."""
    tag = strip(language)
    return F.when(tag.rlike(r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"), tag).otherwise("und")


def settings_hash(settings: Column) -> Column:
    """16 hex digits of a settings text [T24]."""
    return F.substring(F.sha2(settings, 256), 1, 16)
