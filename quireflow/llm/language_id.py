"""Language ID by partial matching (PPM): frozen byte context trees of variable order, exact code lengths.

Every language has a context tree over folded bytes (A-Z as a-z), up to
``order`` bytes deep, and deeper than two only where a context was seen often
enough. A context predicts the bytes seen in it with n / (total + distinct) and
escapes to the next shorter one with distinct / (total + distinct); below the
empty context all 256 bytes are equally likely, and a context that a language
never saw escapes at no cost. The code length of a text is the sum over all its
bytes; the shortest wins, and the score is its posterior probability under
equal priors.

The statistics come from a bounded sample: ``per_lang`` documents of every
language, those with the smallest hashes. Whole texts are learned and scored.
The trees are sparse: what is stored are the contexts and bytes that a language
saw, so that memory follows the sample and not its alphabet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireflow.llm import shingles as S

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The byte taken to stand before a text, as often as the order asks.
_START = 10
#: Bytes of text times languages that are scored at once.
_SCORED = 1 << 21


@dataclass(frozen=True)
class Partial:
    """``per_lang`` documents a language are learned, contexts up to ``order`` bytes; those of three or more bytes that all languages together saw fewer than ``least`` times are pruned.

    ``most`` bounds the distinct (language, context, byte) counts, which the
    driver gathers and sends to every worker; a larger sample is an error.
    """

    per_lang: int = 600
    order: int = 4
    least: int = 4
    most: int = 20_000_000


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Every byte with the ``order`` bytes before it in its text, the byte itself lowest."""
    local = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(np.int64)
    for back in range(1, order + 1):
        c = np.full(len(data), _START, np.int64)
        c[back:] = data[:-back] if len(data) > back else data[:0]
        c[local < back] = _START
        out |= c << (8 * back)
    return out


def learn(docs: DataFrame, p: Partial) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, and language, gram and count of what the sample holds."""
    known = docs.where("lang is not null and text is not null and text <> ''").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    # a hash threshold lets through about twice what is wanted of every language, so that the ranking sees no more at any size
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rates = {r.lang: 2.0 * p.per_lang / r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect() if r.n > 2 * p.per_lang}
    rate = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in rates.items() for x in pair)), F.col("lang")), F.lit(1.0)) if rates else F.lit(1.0)
    rank = Window.partitionBy("lang").orderBy("place", "doc_id")
    sample = known.select("doc_id", "lang", "text", place.alias("place")).where(F.col("place") < rate).withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= p.per_lang)
    order = p.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, j, data, offsets in S.chunks(batch.column(1)):
                gram = grams(_FOLD[data], offsets, order)
                for k in range(i, j):
                    v, n = np.unique(gram[offsets[k - i] : offsets[k - i + 1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([langs[k]] * len(v), pa.string()), pa.array(v), pa.array(n)], names=["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.limit(p.most + 1).toArrow()
    if counts.num_rows > p.most:
        raise ValueError(f"the sample has over {p.most} distinct counts; learn from fewer documents a language")
    langs = sorted(set(counts.column("lang").unique().to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    coded = counts.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = np.array([number[x] for x in coded.dictionary.to_pylist()], dtype=np.int64)
    lang = names[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    return langs, lang, counts.column("gram").to_numpy(), counts.column("n").to_numpy()


@dataclass
class Rows:
    """Ascending keys, and per key the languages that have it, each with a number of bits."""

    keys: np.ndarray
    begin: np.ndarray
    lang: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, lang: np.ndarray, bits: np.ndarray) -> Rows:
        keys, begin = np.unique(key, return_index=True)
        return cls(keys, np.append(begin, len(key)), lang.astype(np.int32), bits.astype(np.float32))

    def at(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index into ``wanted``, language and bits of all that is known of the keys."""
        place = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        hit = np.flatnonzero(self.keys[place] == wanted) if len(self.keys) else np.zeros(0, np.int64)
        low, many = self.begin[place[hit]], self.begin[place[hit] + 1] - self.begin[place[hit]]
        rows = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.repeat(hit, many), self.lang[rows], self.bits[rows]


class Trees:
    """The context trees of all languages: per order, bits of the bytes seen after a context and of its escape."""

    def __init__(self, n_langs: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, least: int):
        self.n_langs, self.order = n_langs, order
        self.seen: list[Rows] = []
        self.escape: list[Rows] = []
        for k in range(order + 1):
            key = gram & ((1 << (8 * (k + 1))) - 1)
            place = np.lexsort((lang, key))
            key_, lang_, n_ = key[place], lang[place], n[place]
            new = np.append(True, (key_[1:] != key_[:-1]) | (lang_[1:] != lang_[:-1])) if len(key_) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            key_, lang_ = key_[starts], lang_[starts]
            n_ = np.add.reduceat(n_, starts) if len(starts) else n_
            context = key_ >> 8
            if k > 2 and len(context):  # keys of a context stand together
                first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                often = np.repeat(np.add.reduceat(n_, first) >= least, np.diff(np.append(first, len(context))))
                key_, lang_, n_, context = key_[often], lang_[often], n_[often], context[often]
            place = np.lexsort((lang_, context))
            both = np.append(True, (context[place][1:] != context[place][:-1]) | (lang_[place][1:] != lang_[place][:-1])) if len(place) else np.zeros(0, bool)
            first = np.flatnonzero(both)
            total = np.add.reduceat(n_[place], first).astype(np.float64) if len(first) else np.zeros(0)
            distinct = np.diff(np.append(first, len(place))).astype(np.float64)
            whole = np.zeros(len(place))
            whole[place] = np.repeat(total + distinct, np.diff(np.append(first, len(place)))) if len(first) else whole
            self.seen.append(Rows.of(key_, lang_, np.log2(whole) - np.log2(n_)))
            self.escape.append(Rows.of(context[place][first], lang_[place][first], np.log2(total + distinct) - np.log2(distinct)))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """The code length of the byte of every gram in its context, a column for every language."""
        out = np.full((len(gram), self.n_langs), 8.0, np.float32)
        for k in range(self.order + 1):
            i, lang, cost = self.escape[k].at((gram >> 8) & ((1 << (8 * k)) - 1))
            out[i, lang] += cost
            i, lang, cost = self.seen[k].at(gram & ((1 << (8 * (k + 1))) - 1))
            out[i, lang] = cost
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in bits, a row for every text and a column for every language."""
        out = np.zeros((len(offsets) - 1, self.n_langs))
        if not len(data):
            return out
        distinct, inverse = np.unique(grams(_FOLD[data], offsets, self.order), return_inverse=True)
        bits = self.bits(distinct)
        some = np.flatnonzero(np.diff(offsets))
        for k in range(self.n_langs):
            out[some, k] = np.add.reduceat(bits[:, k][inverse], offsets[some], dtype=np.float64)
        return out


_trees: dict[bytes, Trees] = {}


def trees_of(key: bytes, *counts) -> Trees:
    """The trees built from the counts, once in a process."""
    if key not in _trees:
        _trees.clear()
        _trees[key] = Trees(*counts)
    return _trees[key]


def language_id(docs: DataFrame, p: Partial = Partial()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_bits of every row.

    held_out: crc32 of doc_id as text, modulo 3, is 1; such rows are not
    learned from. A null text, or one without a letter, gives ``und``, score
    0 and no bits, as does every text where no language was learned. A null
    doc_id is never learned from and has held_out false. Equal code lengths
    give the first language by name. Repeated rows count in the sample each;
    an empty table gives an empty result.
    """
    langs, lang, gram, n = learn(docs, p)
    key = hashlib.sha256(b"".join((lang.tobytes(), gram.tobytes(), n.tobytes(), repr(p).encode()))).digest()
    sent = docs.sparkSession.sparkContext.broadcast((len(langs), lang, gram, n, p.order, p.least))
    size = max(1 << 14, _SCORED // max(1, len(langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = trees_of(key, *sent.value) if langs else None
        names = np.array([*langs, "und"], dtype=object)
        for batch in batches:
            letters = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, offsets in S.chunks(batch.column(2), size):
                best, score, bits = np.full(j - i, len(langs)), np.zeros(j - i), np.zeros(j - i)
                if trees is not None:
                    length = trees.lengths(data, offsets)
                    ok = letters[i:j]
                    best = np.where(ok, length.argmin(axis=1), len(langs))
                    least = length.min(axis=1)
                    score = np.where(ok, 1 / np.exp2(-np.minimum(length - least[:, None], 1000)).sum(axis=1), 0.0)
                    bits = np.where(ok, least, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score), pa.array(bits)], names=["doc_id", "held_out", "lang_pred", "score", "n_bits"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    mine = docs.select("doc_id", held.alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mine.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_bits double")
