"""HTML main text by host suffix arrays.

Pages are cut into blocks by a streaming tokenizer. The distinct pages of a host
are dealt by a hash of their content to shards of bounded size, whose token
streams (the blocks' words, a mark between blocks) are concatenated. A suffix
array over them, sorted to a depth of ``run`` tokens, shows every stretch of at
least that length that distinct pages share: deeper sorting changes nothing, as
a longer shared stretch consists of such runs. Where a host has several shards,
the classes of the array are counted over the whole host and sent back to the
shards that hold them, so that the size of a host changes nothing.

What the array finds decides first. A block outside an article that shared runs
mostly cover is boilerplate; inside an ``article`` or ``main`` element, where
pages may quote each other, it takes a whole block that most of the host's pages
repeat. Then follows a check by markup for what repeats nowhere: elements and
class names of menus, headers, adverts and the like. What stays outside an
article is left out where the article holds the better part of the page.
"""

from __future__ import annotations

import html
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm import shingles as S
from quireflow.llm.common import shuffle_partitions, store, whole_groups

#: Elements without text of their own, elements that are never article text, elements that end a block; fixed values of HTML.
RAW = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "canvas", "textarea", "title", "head", "xmp", "noframes", "noembed"}
CHROME = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "fieldset", "label", "input", "datalist"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open p ends where one of these begins.
CLOSES_P = BLOCK - {"tbody", "td", "tfoot", "th", "thead", "tr", "caption"}
#: Words of class, id and role that name what is not the article.
NOT_TEXT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "announcement", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "disclaimer", "disqus",
    "footer", "form", "gdpr", "header", "hidden", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "respond", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets",
}
#: Words that may stand beside one of these; a name with any other word names something of its own.
BESIDE = {
    "alert", "area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "cards", "center", "col", "column", "container", "content", "count", "desktop", "entry", "extra", "feed", "fixed", "floating", "frame", "full", "global", "group", "holder", "icon", "icons", "info",
    "inline", "inner", "item", "items", "js", "large", "layer", "left", "legal", "link", "links", "list", "local", "main", "message", "mobile", "module", "overlay", "page", "pane", "panel", "placement", "policy", "post", "posts", "primary", "prompt", "rail", "reader", "region", "replies", "reply", "right", "row", "secondary",
    "section", "side", "site", "slot", "small", "space", "sticky", "stories", "strip", "tab", "tabs", "text", "thread", "title", "toggle", "top", "unit", "user", "wide", "wrap", "wrapper", "zone",
}
MAIN = {"article", "main"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADER = re.compile(r"header", re.I)
_SPACE = re.compile(r"\s+")
_SURROGATE = re.compile("[\ud800-\udfff]")

#: Hosts of several shards, and contents of many copies, up to which their tables are broadcast; beyond, they are joined.
FEW = 100_000
#: Copies of one content in a shard.
COPIES = 64
#: Shards whose runs are counted together in one task.
COUNTED = 16

#: Kinds of blocks.
NOISE, PLAIN, ARTICLE = 0, 1, 2


@dataclass(frozen=True)
class Boilerplate:
    """``run`` tokens make a long substring and ``pages`` distinct pages make it boilerplate.

    Inside an article it takes a whole block on ``most`` of the host's distinct pages, and on ``template_pages`` at least.
    Shards hold about ``shard_pages`` distinct pages of one host.
    """

    run: int = 8
    pages: int = 3
    most: float = 0.5
    template_pages: int = 4
    shard_pages: int = 256


def is_noise(name: str, attributes: str) -> bool:
    """Whether an element's name, or a class, id or role of nothing but such words, says that it is not the article."""
    if name in CHROME:
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    for _, value in _NAMES.findall(attributes):
        for one in value.strip("\"'").split():
            words = set(_WORD.findall(_CAMEL.sub(" ", one).lower()))
            if words & NOT_TEXT and words <= NOT_TEXT | BESIDE:
                return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order: references decoded, white space as one space, trimmed, none empty."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # name, noise so far, article so far
    names: Counter[str] = Counter()
    pos, n = 0, len(page)

    def close(name: str) -> None:
        while True:
            last = open_.pop()[0]
            names[last] -= 1
            if last == name:
                return

    def state() -> tuple[bool, bool]:
        return (open_[-1][1], open_[-1][2]) if open_ else (False, False)

    def flush() -> None:
        if text:
            line = _SURROGATE.sub("\ufffd", _SPACE.sub(" ", html.unescape("".join(text)))).strip()
            text.clear()
            if line:
                noise, article = state()
                out.append((NOISE if noise else ARTICLE if article else PLAIN, line))

    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            text.append(page[pos:])
            break
        if m.start() > pos:
            text.append(page[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if names[name]:
                noise = state()
                if name in BLOCK or name in CHROME:
                    flush()
                close(name)
                if state() != noise:
                    flush_as(text, out, noise)
            elif name in BLOCK:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            if name in ("svg", "math", "head", "object", "canvas", "template", "noscript") or not attributes.rstrip().endswith("/"):
                if name == "head":
                    stop = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, pos)
                    pos = n if stop is None else stop.start() if stop[0].lower().startswith("<body") else stop.end()
                else:
                    pos = n if end is None else end.end()
            continue
        if name in BLOCK:
            if name in CLOSES_P and open_ and open_[-1][0] in ("p", "b", "i", "em", "strong", "span", "a") and names["p"]:
                flush()
                close("p")
            elif name == "li" or name in ("dd", "dt", "tr", "td", "th", "option"):
                flush()
                if open_ and open_[-1][0] == name:
                    close(name)
            flush()
        if name == "br":
            text.append(" ")
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            continue
        noise, article = state()
        mine = noise or is_noise(name, attributes) and name not in ("html", "body", "main")
        role_main = "main" in attributes.lower() and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I)
        if mine != noise and name not in BLOCK:
            flush()
        if article and not noise and mine and name in ("header", "div", "section", "hgroup") and not is_noise("div", _HEADER.sub("", attributes)):
            mine = False  # the article's own heading
        open_.append((name, mine, article or name in MAIN or bool(role_main)))
        names[name] += 1
    flush()
    return out


def flush_as(text: list[str], out: list[tuple[int, str]], state: tuple[bool, bool]) -> None:
    """Ends a block of inline noise with the state it had inside."""
    if text and state[0]:
        line = _SURROGATE.sub("\ufffd", _SPACE.sub(" ", html.unescape("".join(text)))).strip()
        text.clear()
        if line:
            out.append((NOISE, line))


def shared_runs(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position, how many distinct pages hold the ``run`` tokens that begin there (0: the page ends before), and the suffix array.

    Prefix doubling: suffixes are ranked by their first 1, 2, 4, ... tokens
    until ``run`` is reached; suffixes never compare beyond their page.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    end = np.searchsorted(page, page, side="right")
    length = 1
    while length < run:
        step = min(length, run - length)
        nxt = np.zeros(n, np.int64)
        inside = np.arange(n) + step < end
        nxt[inside] = rank[np.arange(n)[inside] + step] + 1
        _, rank = np.unique(rank * (n + 1) + nxt, return_inverse=True)
        length += step
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    whole = order + run <= end[order]
    new_class = np.ones(n, bool)
    new_class[1:] = r[1:] != r[:-1]
    new_page = new_class.copy()
    new_page[1:] |= p[1:] != p[:-1]
    starts = np.flatnonzero(new_class)
    many = np.add.reduceat(new_page.astype(np.int64), starts)
    out = np.zeros(n, np.int64)
    out[order] = np.where(whole, np.repeat(many, np.diff(np.append(starts, n))), 0)
    return out, order


#: What stands for the mark between blocks, and the seed of whole blocks beside runs.
_MARK = np.uint64(0x5851F42D4C957F2D)
_BLOCK = np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Streams:
    """The token streams of pages: per token its hash, page and block, and where each block begins (its mark); per block its kind."""

    tokens: np.ndarray
    page: np.ndarray
    block: np.ndarray
    begins: np.ndarray
    kinds: np.ndarray
    first_block: np.ndarray

    @classmethod
    def of(cls, pages: list[list[tuple[int, str]]]) -> Streams:
        texts = [text.encode("utf-8", "surrogatepass") for parts in pages for _, text in parts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]).astype(np.int64)
        _, _, h, first = S.words(np.frombuffer(b"".join(texts), np.uint8), offsets)
        n = len(texts)
        begins = first[:-1] + np.arange(n)
        tokens = np.full(len(h) + n, _MARK, np.uint64)
        words = np.ones(len(tokens), bool)
        words[begins] = False
        tokens[words] = h
        block = np.repeat(np.arange(n), np.diff(np.append(begins, len(tokens))))
        of_page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        kinds = np.array([k for parts in pages for k, _ in parts], np.int64)
        return cls(tokens, of_page[block] if n else block, block, begins, kinds, np.concatenate([[0], np.cumsum([len(p) for p in pages], dtype=np.int64)]).astype(np.int64))


def run_hashes(tokens: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """A hash, the same everywhere, of the ``run`` tokens that begin at each of the places ``at``."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        salts = S.mix(np.arange(1, run + 1, dtype=np.uint64)) | np.uint64(1)
        for k in range(run):
            out += S.mix(tokens[at + k] + np.uint64(k)) * salts[k]
    return S.mix(out)


def block_hashes(s: Streams) -> np.ndarray:
    """A hash of the words of each block in order."""
    if not len(s.begins):
        return np.zeros(0, np.uint64)
    place = (np.arange(len(s.tokens)) - s.begins[s.block]).astype(np.uint64)
    with np.errstate(over="ignore"):
        return S.mix(np.add.reduceat(S.mix(s.tokens + S.mix(place)), s.begins) ^ _BLOCK)


def covered(counts: np.ndarray, needed: int, run: int) -> np.ndarray:
    """Whether some run that enough pages share covers the position."""
    n = len(counts)
    delta = np.zeros(n + run + 1, np.int64)
    begin = np.flatnonzero(counts >= max(needed, 2))
    np.add.at(delta, begin, 1)
    np.add.at(delta, begin + run, -1)
    return np.cumsum(delta)[:n] > 0


def wanted_runs(s: Streams, run: int) -> np.ndarray:
    """Places where a whole run begins that touches a block outside an article."""
    n = len(s.tokens)
    whole = np.arange(n) + run <= np.searchsorted(s.page, s.page, side="right") if n else np.zeros(0, bool)
    outside = np.concatenate([[0], np.cumsum(s.kinds[s.block] != ARTICLE)]) if n else np.zeros(1, np.int64)
    touched = outside[np.minimum(np.arange(n) + run, n)] > outside[:n]
    return np.flatnonzero(whole & touched)


def shard_entries(s: Streams, lead: np.ndarray, b: Boilerplate) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the wanted runs, hashes of the blocks, and all distinct hashes with the number of leading pages that hold them."""
    at = wanted_runs(s, b.run)
    runs, whole = run_hashes(s.tokens, at, b.run), block_hashes(s)
    counted = np.flatnonzero(lead[s.page]) if len(s.page) else np.zeros(0, np.int64)
    counts = np.zeros(len(s.tokens), np.int64)
    counts[counted], _ = shared_runs(s.tokens[counted], s.page[counted], b.run)
    inside = s.kinds == ARTICLE
    pages = s.page[s.begins][inside] if len(s.begins) else np.zeros(0, np.int64)
    once = np.unique(np.stack([whole[inside], pages.astype(np.uint64)]), axis=1) if inside.any() else np.zeros((2, 0), np.uint64)
    keys = np.concatenate([runs, once[0]])
    n = np.concatenate([counts[at], lead[once[1].astype(np.int64)].astype(np.int64)])
    distinct, inverse = np.unique(keys, return_inverse=True)
    most = np.zeros(len(distinct), np.int64)
    np.maximum.at(most, inverse[: len(runs)], n[: len(runs)])
    np.add.at(most, inverse[len(runs) :], n[len(runs) :])
    return at, runs, whole, distinct, most


def shard_texts(pages: list[list[tuple[int, str]]], b: Boilerplate, lead: list[bool] | None = None, of_host: tuple[np.ndarray, np.ndarray, int] | None = None) -> list[tuple[str, int, int]]:
    """The main text of each of a shard's pages, and how many blocks the array and then the markup took.

    Pages of equal content count once. ``of_host``, where the shard is a part
    of its host: hashes, ascending, their distinct pages on the host, and the
    host's distinct pages.
    """
    contents: dict[tuple, int] = {}
    ids = [contents.setdefault(tuple(parts), len(contents)) for parts in pages]
    some = [list(c) for c in contents]
    s = Streams.of(some)
    leads = np.ones(len(some), bool)
    at, runs, whole, keys, totals = shard_entries(s, leads, b)
    distinct = len(some)
    if of_host is not None:
        keys, totals, distinct = of_host
    found = np.zeros(len(s.tokens), np.int64)
    in_article = np.zeros(len(s.kinds), np.int64)
    if len(keys):
        for out, where, mine in ((found, at, runs), (in_article, np.arange(len(whole)), whole)):
            place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            out[where] = np.where(keys[place] == mine, totals[place], 0)
    share = np.bincount(s.block, weights=covered(found, b.pages, b.run), minlength=len(s.kinds)) / np.maximum(np.bincount(s.block, minlength=len(s.kinds)), 1)
    words = np.diff(np.append(s.begins, len(s.tokens))) - 1
    outcome = []
    for k in range(len(some)):
        a, z = s.first_block[k], s.first_block[k + 1]
        kind, size = s.kinds[a:z], words[a:z]
        main = kind == ARTICLE
        template = main & (in_article[a:z] >= max(b.template_pages, int(np.ceil(b.most * distinct))))
        # a page most of whose article is shared is a copy, not a template
        if 2 * size[template].sum() >= size[main].sum():
            template[:] = False
        array = template | ~main & (share[a:z] > 0.5)
        markup = ~array & (kind == NOISE)
        stay = ~array & ~markup
        if 2 * size[stay & main].sum() >= size[stay].sum() and (stay & main).any():
            markup |= stay & ~main
            stay &= main
        outcome.append(("\n".join(text for (_, text), x in zip(some[k], stay) if x), int(array.sum()), int(markup.sum())))
    return [outcome[k] for k in ids]


def packed(parts: list[tuple[int, str]]) -> bytes:
    """A page's blocks as compressed bytes: their number, kinds, texts."""
    return zlib.compress(struct.pack("<I", len(parts)) + bytes(k for k, _ in parts) + "\n".join(t for _, t in parts).encode("utf-8", "surrogatepass"), 3)


def unpacked(raw: bytes) -> list[tuple[int, str]]:
    data = zlib.decompress(raw)
    n = struct.unpack_from("<I", data)[0]
    return list(zip(data[4 : 4 + n], data[4 + n :].decode("utf-8", "surrogatepass").split("\n"))) if n else []


def html_text(pages: DataFrame, b: Boilerplate = Boilerplate()) -> DataFrame:
    """page_id, url, text, n_chars, n_by_array, n_by_markup of every row.

    The last two count the blocks that the array took and those that only
    markup did. A null html is empty and gives an empty text; rows without a
    url that names a host count to one host without a name. Unclosed elements
    end with the page; a lone surrogate of a character reference becomes
    U+FFFD. Equal pages come out alike and count as one page, in however many
    shards their copies lie. Other columns are not read. An empty table gives
    an empty result.
    """
    spark = pages.sparkSession
    n = shuffle_partitions(spark)
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    mine = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    mine = mine.withColumn("content", F.xxhash64("html").bitwiseAND(F.lit((1 << 62) - 1)))
    contents = store(mine.groupBy("host", "content").agg(F.count("*").alias("copies")))
    often = contents.where(F.col("copies") > COPIES)
    hosts = contents.groupBy("host").agg(F.count("*").alias("distinct"), F.max((F.col("copies") > COPIES).cast("int")).alias("crowded"))
    hosts = hosts.withColumn("shards", F.ceil(F.col("distinct") / b.shard_pages)).where("shards > 1 or crowded = 1").drop("crowded")

    def light(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [packed(blocks(x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 3, 4)), pa.array(raw, pa.binary())], names=["page_id", "url", "host", "content", "blocks"])

    id_kind = pages.schema["page_id"].dataType.simpleString()
    parted = mine.mapInArrow(cut, f"page_id {id_kind}, url string, host long, content long, blocks binary")
    dealt = parted.join(light(store(hosts)), "host", "left").join(light(often), ["host", "content"], "left")
    copy = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.ceil(F.col("copies") / COPIES)), F.lit(0)).cast("long")
    shard = F.pmod("content", F.coalesce("shards", F.lit(1))) + copy * (1 << 32)
    dealt = dealt.select("host", shard.alias("shard"), "page_id", "url", "blocks", F.col("shards").isNotNull().alias("part"), F.coalesce("distinct", F.lit(0)).alias("distinct"), F.coalesce("shards", F.lit(0)).alias("shards"))
    # one exchange for all that follows; the number keeps the filters above it, so that it stays the same exchange
    dealt = dealt.repartition(n, "host", "shard").withColumn("barrier", F.monotonically_increasing_id())
    names = ["page_id", "url", "text", "n_by_array", "n_by_markup"]
    schema = f"page_id {id_kind}, url string, text string, n_by_array int, n_by_markup int"

    def answer(part: pa.Table, texts: list[tuple[str, int, int]]) -> list[pa.ChunkedArray | pa.Array]:
        return [part.column("page_id"), part.column("url"), *(pa.array([x[k] for x in texts], kind) for k, kind in ((0, pa.string()), (1, pa.int32()), (2, pa.int32())))]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["host", "shard"], 256):
            parts = [unpacked(x) for x in rows.column("blocks").to_pylist()]
            texts = []
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                texts += shard_texts(parts[a:z], b)
            yield from pa.table(answer(rows, texts), names=names).to_batches()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["host", "shard"], 256):
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                part = rows.slice(a, z - a)
                some = [list(x) for x in {tuple(unpacked(x)): None for x in part.column("blocks").to_pylist()}]
                host, number, shards = (part.column(k)[0].as_py() for k in ("host", "shard", "shards"))
                # further copies of a content are counted in its first shard
                _, _, _, keys, totals = shard_entries(Streams.of(some), np.full(len(some), number < 1 << 32), b)
                bucket = (keys >> np.uint64(40)).astype(np.int64) % max(1, -(-shards // COUNTED))
                order = np.argsort(bucket, kind="stable")
                for x in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(keys) else []:
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (host, int(bucket[x[0]]), number)] + [pa.array([keys[x].tobytes()], pa.binary()), pa.array([totals[x].astype(np.uint32).tobytes()], pa.binary())], names=["host", "bucket", "shard", "keys", "totals"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = min(b.pages, b.template_pages)
        for rows, starts in whole_groups(batches, ["host", "bucket"], 1):
            columns = [rows.column(k).to_pylist() for k in ("host", "shard", "keys", "totals")]
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows]):
                keys = [np.frombuffer(x, np.uint64) for x in columns[2][a:z]]
                distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                totals = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, np.uint32) for x in columns[3][a:z]]), minlength=len(distinct)).astype(np.uint32)
                ends = np.cumsum([len(k) for k in keys])
                for i in range(a, z):
                    mine = inverse[ends[i - a] - len(keys[i - a]) : ends[i - a]]
                    mine = mine[totals[mine] >= least]
                    if len(mine):
                        yield pa.RecordBatch.from_arrays([pa.array([columns[0][i]], pa.int64()), pa.array([columns[1][i]], pa.int64()), pa.array([distinct[mine].tobytes()], pa.binary()), pa.array([totals[mine].tobytes()], pa.binary())], names=["host", "shard", "keys", "totals"])

    def together(part: pa.Table, found: pa.Table) -> pa.Table:
        keys, totals = (np.frombuffer(b"".join(found.column(k).to_pylist()), kind) for k, kind in (("keys", np.uint64), ("totals", np.uint32)))
        order = np.argsort(keys)
        texts = shard_texts([unpacked(x) for x in part.column("blocks").to_pylist()], b, of_host=(keys[order], totals[order].astype(np.int64), part.column("distinct")[0].as_py())) if part.num_rows else []
        return pa.table(answer(part, texts), names=names)

    columns = ["host", "shard", "page_id", "url", "blocks", "distinct", "shards"]  # the same everywhere, or the exchange is another one
    single = dealt.where("not part and barrier >= 0").select(*columns).sortWithinPartitions("host", "shard").mapInArrow(alone, schema)
    many = dealt.where("part and barrier >= 0").select(*columns)
    entries = many.sortWithinPartitions("host", "shard").mapInArrow(counted, "host long, bucket long, shard long, keys binary, totals binary")
    shared = entries.repartition(n, "host", "bucket").sortWithinPartitions("host", "bucket").mapInArrow(summed, "host long, shard long, keys binary, totals binary")
    parts = many.groupBy("host", "shard").cogroup(shared.groupBy("host", "shard")).applyInArrow(together, schema)
    return single.unionByName(parts).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_by_array", "n_by_markup")
