"""Thresholds, word lists and patterns of the structuring rules.

Fixed values: results depend on them. Operator IDs in brackets.
"""

from __future__ import annotations

from dataclasses import dataclass

# characters
TATWEEL = "ـ"
DIACRITICS = "[ً-ْٰ]"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
LATIN_DIGITS = "0123456789"
TERMINAL = ".؟!:»۔"
ARABIC_OR_DIGIT = "[ء-ي٠-٩]"

# line filters [F04, F05]
WATERMARKS = [r"https?://\S+", r"www\.\S+", r"kotob\s*\.?\s*has\s*\.?\s*it", r"noor[\s-]*book"]
PAGE_NUMBER = "^\\s*[-–—(\\[]?\\s*[0-9٠-٩]{1,4}\\s*[-–—)\\]]?\\s*$"

# headings [F16, T14]
HEADING_WORDS = ["الباب", "الفصل", "باب", "فصل", "مقدمة", "المقدمة", "تمهيد", "خاتمة", "الخاتمة", "فهرس", "المراجع", "ملحق"]
HEADING_MAX_WORDS = 8

# lists [T13]
LIST_ORDERED = "^\\s*[0-9٠-٩]{1,3}\\s*[.)\\-]\\s+(\\S.*)$"
LIST_BULLET = "^\\s*[•‣◦·∙*●▪]\\s+(\\S.*)$"

# notes [W06, T15]
NOTE_MARKER = "^\\s*(?:\\(\\s*([0-9٠-٩]{1,3})\\s*\\)|([0-9٠-٩]{1,3})\\s*[-–.)]|([¹²³⁰-⁹]{1,3}))\\s+"

# quotations [W08, T11]
QUOTE_CUE = r"قال\s+(الله\s+)?تعالى|قوله\s+تعالى|قرآن\s+كريم|سورة\s+\S+|عز\s+وجل"
QUOTE_SOURCE = r"^\s*(قرآن\s+كريم|سورة\s+\S+(\s+آية\s+\S+)?)\s*$"
QUOTE_BRACKETS = "[«﴿]([^«»﴾﴿]{8,400})[»﴾]"

# damaged text layers [T07]
LONE_LAM = "(?:^|\\s)ل(?:\\s|$)"
MISPLACED_HAMZA = "[بتثجحخسشصضطظعغفقكمنهي][إأآ]"

# Markdown [T17-T19]
PAGE_COMMENT = r"^<!--\s*page:(\p{Nd}+)\s*-->$"
SCAN = r"^!\[[^\]]*\]\((.+)\)$"
MD_BULLET = "^[-*•‣◦·∙●▪٭]\\s+(.*)$"
MD_ORDERED = "^[0-9٠-٩]{1,3}\\s*[.)\\-]\\s+(.*)$"
MD_NOTE = r"^\[\^([^\]\s]+)\]:\s*(.*)$"
MD_NEEDS_ESCAPE = "^(#{1,6}\\s|[-*•‣◦·∙●▪٭]\\s|[0-9٠-٩]{1,3}\\s*[.)\\-]\\s|:::|<!--|!\\[|\\[\\^|\\\\)"


@dataclass(frozen=True)
class Repeated:
    """Header and footer mining [A01]."""

    min_pages: int = 5
    min_ratio: float = 0.4
    least: int = 3
    fuzzy: float = 0.85
    max_length: int = 60
    min_key: int = 4
    max_key_gap: int = 4


@dataclass(frozen=True)
class Script:
    """Which lines are junk [F06] and which pages foreign [F11]; ``latin`` switches the Arabic tests off."""

    arabic: bool = True
    junk_short: int = 4
    edge_short: int = 3
    edge_length: int = 35
    edge_ratio: float = 0.4
    min_ratio: float = 0.65


ARABIC = Script()
LATIN = Script(arabic=False)


@dataclass(frozen=True)
class Layer:
    """Text layer verdict [F08-F10]."""

    candidate_chars: int = 20
    bad_glyphs: float = 0.05
    measurable_words: int = 40
    measurable_pages: int = 3
    corrupt_share: float = 0.25
    sample_chars: int = 4000
    lone_lam: float = 0.01
    misplaced_hamza: float = 0.02


@dataclass(frozen=True)
class Recognition:
    """Acceptance of recognised pages [F11, F12]."""

    min_confidence: float = 40.0
    min_words: int = 15
    rescue_margin: float = 15.0


@dataclass(frozen=True)
class Geometry:
    """Paragraphs [W02], headings [T14], notes [W06, F17]."""

    gap: float = 1.8
    indent: float = 1.2
    short: float = 0.7
    h1: float = 1.7
    h2: float = 1.35
    big: float = 1.15
    bold: float = 0.6
    bold_size: float = 0.98
    centred: float = 0.12
    zone: float = 0.55
    note_size: float = 0.85
    note_height: float = 0.80


@dataclass(frozen=True)
class Coverage:
    """Floors of the report [A10] and of the flat fallback [C04]."""

    book: float = 0.95
    page: float = 0.80
    min_chars: int = 40
    shown: int = 10


#: Resource limits [F19].
MAX_PAGES = 5_000
MAX_ELEMENTS = 2_000_000
MAX_NOTES_PER_PAGE = 200
MAX_SCAN_BYTES = 256 * 1024 * 1024
MAX_PAGE_PIXELS = 40_000_000
MAX_BOOK_PIXELS = 20_000_000_000

#: Chapter weights [A12, W14].
IMAGE_WEIGHT = 150_000
MAX_CHAPTER_WEIGHT = 400_000
TARGET_CHAPTER_WEIGHT = 250_000

#: Device table [S21]: key, label, width, height, ppi.
DEVICES = [
    ("generic-6in", "Generic 6-inch e-reader", 758, 1024, 212),
    ("generic-6in-hd", "Generic 6-inch HD e-reader", 1072, 1448, 300),
    ("xteink-x4", "Xteink X4 (CrossPoint)", 480, 800, 220),
    ("kindle-pw11", "Kindle Paperwhite 11", 1236, 1648, 300),
    ("none", "Keep source resolution", 0, 0, 0),
]
