"""Substring dedup: MinHash of sliding paragraphs as candidates, exact Jaccard verification of whole passages.

A text's paragraphs slide over it: every run of ``window`` consecutive
five-word shingles is one, and its MinHash is the shingle with the smallest
hash. Overlapping paragraphs share most minima, so each minimum is emitted
once. Texts that share a minimum become candidates of the first document that
has it; so that a frequent shingle does not hide closer texts, they become
candidates also of the first document that shares the shingles before it,
after it, or both. A candidate pair's texts, from the first to the last shared
minimum and a margin beyond, are then aligned on all their shingles: runs of
equal shingles are joined over edits into the longest passages with Jaccard
similarity >= 0.8, whose ends are those of the match.

A passage of a text that an earlier document has is removed. Where that
document's own passage is removed for a still earlier one, the text is kept
there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm import shingles as S
from quireflow.llm.common import discard, ragged, shuffle_partitions, store, whole_groups


@dataclass(frozen=True)
class Paragraphs:
    """``window`` shingles a sliding paragraph; ``before`` shingles of the span before its minimum, ``shingles`` in all, as many as a passage must share.

    A run of ``window`` shared shingles always shows a shared minimum. Passages
    of similarity >= 0.8 with an edit inside have 45 shingles at least and one
    run of 20 at least, so that 20 misses none of them for want of a candidate;
    a run of s < 20 shingles is missed with a chance of at most 1 - s / 20.
    """

    window: int = 20
    before: int = 6
    shingles: int = 12


def minima(sh: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Positions that are smallest in some run of ``window`` shingles of their text (the whole text where it is shorter).

    Of equal minima less than a window apart, one a window is taken.
    """
    n, sizes = len(sh), np.diff(at)
    if not n:
        return np.zeros(0, np.int64)
    least, width = sh, 1
    while width < window:
        step = min(width, window - width)
        shifted = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        if step < n:
            shifted[: n - step] = least[step:]
        least, width = np.minimum(least, shifted), width + step
    text = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.arange(n) + window <= at[text + 1]
    most = np.where(valid, least, np.uint64(0))
    width = 1
    while width < window:
        step = min(width, window - width)
        shifted = np.zeros(n, np.uint64)
        if step < n:
            shifted[step:] = most[: n - step]
        most, width = np.maximum(most, shifted), width + step
    # no valid window reaches past its text, so a position's windows are all of its own text
    some = np.flatnonzero(sizes)
    own = np.minimum.reduceat(sh, at[some])[np.searchsorted(some, text)]
    hit = np.flatnonzero(np.where(sizes[text] < window, own, most) == sh)
    if len(hit) > 1:
        tied = np.zeros(len(hit), bool)
        tied[1:] = (sh[hit[1:]] == sh[hit[:-1]]) & (hit[1:] - hit[:-1] < window) & (text[hit[1:]] == text[hit[:-1]])
        opens = np.maximum.accumulate(np.where(tied, 0, np.arange(len(hit))))
        place = (hit - hit[opens]) // window
        again = tied.copy()
        again[1:] &= place[1:] == place[:-1]
        hit = hit[~again]
    return hit


def minima_of(data: np.ndarray, offsets: np.ndarray, p: Paragraphs) -> tuple[np.ndarray, ...]:
    """text, place, the shingle itself and with those before and after it in its span (0: the text ends before), and whether it is a repeat in its text, of every minimum."""
    _, _, h, first = S.words(data, offsets)
    sh, at = S.shingle_hashes(h, first)
    a = minima(sh, at, p.window)
    text = np.searchsorted(at, a, side="right") - 1
    local, key = a - at[text], sh[a]
    after = p.shingles - p.before - 1
    sides = []
    with np.errstate(over="ignore"):
        for low, n, whole in ((-p.before, p.before + 1, local >= p.before), (0, after + 1, local + after < np.diff(at)[text])):
            side = np.zeros(len(a), np.uint64)
            salts = S.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
            around = sh[(a[whole] + low)[:, None] + np.arange(n)]
            side[whole] = S.mix((around * salts).sum(axis=1, dtype=np.uint64) + np.uint64(n))
            sides.append(side)
    order = np.lexsort((a, key, text))
    again = np.zeros(len(a), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    return text, local, key, *sides, again


def _minima(docs: DataFrame, p: Paragraphs) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in S.chunks(batch.column(2)):
                text, place, key, left, right, again = minima_of(data, offsets, p)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][text].astype(np.int64)), pa.array(hashes[i:j][text].astype(np.int32)), pa.array(place.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (key, left, right)), pa.array(again)], names=["doc_id", "text_hash", "at", "key", "left", "right", "again"])

    return docs.mapInArrow(run, "doc_id long, text_hash int, at int, key long, left long, right long, again boolean")


def matches(mine: np.ndarray, other: np.ndarray, ahead: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the shingles of ``mine`` that ``other`` has, and one place there: that after the last one's where it fits, else the first.

    ``ahead``: both are parts of one text, ``mine`` beginning so many places
    after ``other``, and only earlier places of the text count.
    """
    order = np.argsort(other, kind="stable")
    ordered = other[order]
    at = np.searchsorted(ordered, mine)
    hit = ordered[np.minimum(at, len(other) - 1)] == mine if len(other) else np.zeros(len(mine), bool)
    i = np.flatnonzero(hit)
    j = order[at[i]]
    if (ordered[1:] == ordered[:-1]).any():
        last = -1
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            if k and i[k - 1] == x - 1 and last + 1 < len(other) and other[last + 1] == mine[x] and not (ahead is not None and last + 1 >= x + ahead):
                j[k] = y = last + 1
            last = y
    if ahead is not None:
        some = j < i + ahead
        i, j = i[some], j[some]
    return i, j


def common_passages(i: np.ndarray, j: np.ndarray, p: Paragraphs) -> list[tuple[int, int, int, int]]:
    """(start, end, start there, end there), in words, of the passages of two texts with matching shingles i, j whose Jaccard similarity is >= 0.8.

    Runs of matches on one diagonal are joined over edits of less than a window
    into the longest stretches in which the shared shingles are at least four
    times those that only one side has, that is four fifths of all.
    """
    if len(i) < p.shingles:
        return []
    opens = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1)))
    closes = np.append(opens[1:], len(i)) - 1
    over_i, over_j = i[opens[1:]] - i[closes[:-1]] - 1, j[opens[1:]] - j[closes[:-1]] - 1
    # a run that steps back in the other text begins anew
    far = (np.maximum(over_i, over_j) > p.window) | (over_j < 0)
    out = []
    for part in np.split(np.arange(len(opens)), np.flatnonzero(far) + 1):
        shared = np.cumsum(closes[part] - opens[part] + 1)
        missed = np.append(0, np.cumsum((over_i + over_j)[part[:-1]]))
        # score of the stretch from run a to run b: after[b] - before[a]
        after, before = shared - 4 * missed, np.append(0, shared[:-1]) - 4 * missed
        best = np.maximum.accumulate(after[::-1])[::-1]
        last = np.searchsorted(-best, -before, side="right") - 1
        reach = -1
        for a, b in enumerate(last.tolist()):
            if b <= reach:
                continue
            if shared[b] - (shared[a - 1] if a else 0) >= p.shingles:
                x, y = opens[part[a]], closes[part[b]]
                out.append((int(i[x]), int(i[y]) + S.WORDS, int(j[x]), int(j[y]) + S.WORDS))
                reach = b
    return out


def _pairs(docs: DataFrame, p: Paragraphs) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, rep, low, high): texts, the first documents with which they share a minimum, alone or with its neighbours on either side or both, and the first and last place of these; and (doc_id, text_hash, low, high) of all shared minima of a text."""
    # the minima are cheaper to compute twice than to store
    often = _minima(docs, p).groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
    hits = store(_minima(docs, p).join(often, "key"))
    found = hits.where("doc_id <> rep or again").select("doc_id", "text_hash", "rep", "at")
    sides = {"left": F.col("left"), "right": F.col("right"), "both": F.when((F.col("left") != 0) & (F.col("right") != 0), F.xxhash64("left", "right")).otherwise(0)}
    for side in sides.values():
        closer = hits.select("doc_id", "text_hash", "at", side.alias("side")).where("side <> 0")
        first = closer.groupBy("side").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
        found = found.union(closer.join(first, "side").where("doc_id <> rep").select("doc_id", "text_hash", "rep", "at"))
    ends = F.min("at").alias("low"), F.max("at").alias("high")
    pairs = store(found.groupBy("doc_id", "text_hash", "rep").agg(*ends))
    spans = store(hits.groupBy("doc_id", "text_hash").agg(*ends).join(pairs.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    discard(hits)
    return pairs, spans


#: Texts that are compared with one document in one task.
_COMPARED = 64
#: Bytes of a shingle's hash that are compared; two texts of 10,000 shingles have a false match with a chance of 4e-7.
_WIDTH = 6


def _cut_out(docs: DataFrame, jobs: DataFrame, margin: int) -> DataFrame:
    """(rep, salt, shards, doc_id, text_hash, begin, sh): of every text the stretches of shingles that its jobs ask for; a null salt is one held against others."""
    schema = "rep long, salt int, shards int, doc_id long, text_hash int, begin int, sh binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, shards = (batch.column(k).to_pylist() for k in (0, 1, 6))
            lows, highs, asks = (batch.column(k).to_pylist() for k in (4, 5, 3))
            for i, j, data, offsets in S.chunks(batch.column(2)):
                _, _, h, first = S.words(data, offsets)
                sh, at = S.shingle_hashes(h, first)
                raw = np.ascontiguousarray(sh).view(np.uint8).reshape(-1, 8)[:, :_WIDTH]
                rows = []
                for k in range(i, j):
                    a, z = int(at[k - i]), int(at[k - i + 1])

                    def stretch(low: int, high: int) -> tuple[int, bytes]:
                        begin = max(0, low - margin)
                        return begin, raw[a + begin : min(z, a + high + margin + 1)].tobytes()

                    rows += [(x["rep"], x["salt"], None, ids[k], hashes[k], *stretch(x["low"], x["high"])) for x in asks[k] or []]
                    if shards[k] is not None:
                        rows.append((ids[k], None, shards[k], ids[k], hashes[k], *stretch(lows[k], highs[k])))
                columns = zip(*rows) if rows else [()] * 7
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["rep", "salt", "shards", "doc_id", "text_hash", "begin", "sh"])

    return docs.join(jobs, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "asks", "low", "high", "shards").mapInArrow(run, schema)


def _passages(docs: DataFrame, p: Paragraphs) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word, rep, rep_start, rep_end): verified passages of the candidate pairs."""
    pairs, spans = _pairs(docs, p)
    shards = store(pairs.groupBy("rep").agg(F.ceil(F.count("*") / _COMPARED).cast("int").alias("shards")))
    salted = pairs.join(shards.where("shards > 1"), "rep", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.coalesce("shards", F.lit(1)).cast("long")).cast("int"))
    # a text has no more partners than minima, so that its list is bounded by its own length
    asking = salted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("rep", "salt", "low", "high")).alias("asks"))
    held = spans.join(shards.withColumnRenamed("rep", "doc_id"), "doc_id")
    parts = _cut_out(docs, asking.join(held, ["doc_id", "text_hash"], "full"), 2 * p.window + p.shingles)
    order = ["rep", "salt"]
    everywhere = F.explode(F.when(F.col("salt").isNotNull(), F.array("salt")).otherwise(F.sequence(F.lit(0), F.col("shards") - 1)))
    rows = parts.select("rep", everywhere.alias("salt"), F.col("salt").isNotNull().alias("asks"), "doc_id", "text_hash", "begin", "sh")
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, order, 512):
            rep, asks, doc, text_hash, begin = (rows.column(k).to_numpy() for k in ("rep", "asks", "doc_id", "text_hash", "begin"))
            data, offsets = ragged(rows.column("sh"))
            at = offsets // _WIDTH
            sh = np.zeros((int(at[-1]), 8), np.uint8)
            sh[:, :_WIDTH] = data.reshape(-1, _WIDTH)
            sh = sh.view(np.uint64).ravel()
            out: list[tuple[int, ...]] = []
            for a, z in zip(starts.tolist(), np.append(starts[1:], rows.num_rows).tolist()):
                middle = a + int(np.count_nonzero(~asks[a:z]))
                for k in range(middle, z):
                    for r in range(a, middle):
                        own = doc[k] == rep[r]
                        if own and text_hash[k] != text_hash[r]:
                            continue
                        i, j = matches(sh[at[k] : at[k + 1]], sh[at[r] : at[r + 1]], int(begin[k] - begin[r]) if own else None)
                        out += [(doc[k], text_hash[k], s + begin[k], e + begin[k], rep[r], rs + begin[r], re + begin[r]) for s, e, rs, re in common_passages(i, j, p)]
            columns = np.array(out, np.int64).reshape(-1, 7).T
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds)], names=["doc_id", "text_hash", "start_word", "end_word", "rep", "rep_start", "rep_end"])

    out = store(rows.mapInArrow(run, "doc_id long, text_hash int, start_word int, end_word int, rep long, rep_start int, rep_end int").distinct())
    for made in (pairs, spans, shards):
        discard(made)
    return out


def _islands(ranges: DataFrame, of: list[str], start: str, end: str) -> DataFrame:
    """``ranges`` with the number ``island`` of the group of overlapping or touching ranges of their text."""
    order = Window.partitionBy(*of).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("opens", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
    return ranges.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def duplicate_spans(docs: DataFrame, p: Paragraphs = Paragraphs()) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word, n_paragraphs, component_id, kept_doc_id): the word ranges to remove.

    end_word is exclusive; n_paragraphs counts the verified passages in the
    range; kept_doc_id is the document that keeps its text and component_id
    tells the passages kept apart. Only passages found in two or more documents
    count. Null, empty and short texts (under 16 words) have no spans; rows
    with a null doc_id are left alone; fully repeated rows are one document;
    text_hash tells rows of one doc_id apart. Ties go to the smaller position.
    An empty table gives an empty result.
    """
    mine = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.hash("text").alias("text_hash"), "text")
    ranges = _islands(_passages(mine, p), ["doc_id", "text_hash"], "start_word", "end_word")
    first = F.min(F.struct("rep", "rep_start", "rep_end"))
    at = store(ranges.groupBy("doc_id", "text_hash", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.count("*").alias("n_paragraphs"), first.alias("k")).drop("island"))
    # where the text found was itself removed, it is kept where that one points to; places only go down
    onward = at.select(F.col("doc_id").alias("on_id"), F.col("start_word").alias("on_start"), F.col("end_word").alias("on_end"), F.col("k").alias("on_k"))
    moved = at
    while True:
        inside = (F.col("k.rep") == F.col("on_id")) & (F.col("k.rep_start") < F.col("on_end")) & (F.col("k.rep_end") > F.col("on_start")) & (F.col("on_k") < F.col("k"))
        new = store(moved.join(onward, inside, "left").groupBy("doc_id", "text_hash", "start_word", "end_word", "n_paragraphs", "k").agg(F.min("on_k").alias("on_k")))
        if moved is not at:
            discard(old)
        if new.where("on_k is not null").isEmpty():
            break
        old = new
        moved = new.select("doc_id", "text_hash", "start_word", "end_word", "n_paragraphs", F.coalesce("on_k", "k").alias("k"))
    kept = _islands(new.select("doc_id", "text_hash", "start_word", "end_word", "n_paragraphs", "k.*"), ["rep"], "rep_start", "rep_end")
    return kept.select("doc_id", "text_hash", "start_word", "end_word", "n_paragraphs", F.xxhash64("rep", "island").alias("component_id"), F.col("rep").alias("kept_doc_id"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the words of ``spans`` taken out of ``text``, each range with the white space before its end.

    Texts without a span stay byte for byte; other columns are kept as they are.
    """
    names = docs.columns
    # helper columns under names that the table does not have
    ident, hashed, froms, tos = (f"{'_' * max(map(len, names))}{k}" for k in ("id", "hash", "from", "to"))
    ranges = F.sort_array(F.collect_list(F.struct(F.col("start_word").cast("int").alias("start_word"), F.col("end_word").cast("int").alias("end_word"))))
    lists = spans.groupBy(F.col("doc_id").alias(ident), F.col("text_hash").alias(hashed)).agg(ranges.alias("r"))
    lists = lists.select(ident, hashed, F.col("r.start_word").alias(froms), F.col("r.end_word").alias(tos))
    joined = docs.join(lists, (F.col("doc_id").cast("long") == F.col(ident)) & (F.hash("text") == F.col(hashed)), "left").drop(ident, hashed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, begins, ends = batch.column(at), batch.column(len(names)), batch.column(len(names) + 1)
            if begins.null_count < len(begins):
                new = texts.to_pylist()
                for i in np.flatnonzero(begins.is_valid().to_numpy(zero_copy_only=False)):
                    new[i] = cut(new[i], begins[i].as_py(), ends[i].as_py())
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(len(names))], names=names)

    return joined.select(*(F.col(f"`{c}`") for c in [*names, froms, tos])).mapInArrow(run, docs.schema)


def cut(text: str, froms: list[int], tos: list[int]) -> str:
    """``text`` without the words [from, to) of the ascending, disjoint ranges."""
    raw = np.frombuffer(text.encode(), np.uint8)
    s, _, _, _ = S.words(raw, np.array([0, len(raw)]))
    starts = np.append(s, len(raw))
    out, last = [], 0
    for a, b in zip(froms, tos):
        out.append(raw[last : starts[min(a, len(s))]].tobytes())
        last = int(starts[min(b, len(s))])
    out.append(raw[last:].tobytes())
    return b"".join(out).decode()
