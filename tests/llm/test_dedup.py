"""Line dedup, n-gram join, substring dedup and vectors against brute force, with nulls, ties and empty tables."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from quireflow.llm import shingles as S
from quireflow.llm.line_dedup import line_dedup, without_lines
from quireflow.llm.ngram_join import Forest, estimated_recall, ngram_jaccard_join
from quireflow.llm.substring_dedup import cut, duplicate_spans, minima, remove_spans
from quireflow.llm.vectors import Descent, vector_near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, group string, node string, n_lines int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "g", "x", 1) for i, t in rows], SCHEMA)


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def shingles(text):
    w = [x.lower() for x in (text or "").replace("\x0b", " ").split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def reach(nodes, links):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_match_python_split():
    texts = ["", " a  b\nc ", "É été", "x" * 300, "\x0b\x0ca\tb\r"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    s, e, h, first = S.words(data, offsets)
    got = [b"".join(raw)[a:b].decode() for a, b in zip(s, e)]
    assert got == [w for t in texts for w in t.split()]
    assert list(np.diff(first)) == [len(t.split()) for t in texts]
    assert len(set(h.tolist())) == len({w.lower() for w in got})


def test_line_dedup(spark):
    long_line = "This line is long enough to be counted as boilerplate"
    rows = [(i, f"{'  ' if i % 2 else ''}{long_line.upper() if i == 3 else long_line}\nown {i}\n{long_line}") for i in range(1, 7)]
    rows += [(7, None), (8, ""), (None, long_line), (9, "short\nshort"), (10, "É" * 50), (11, "é" * 50 + "\n")]
    got = {r.doc_id: r for r in line_dedup(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(1, 6):
        assert (got[i].n_lines, got[i].n_dropped) == (3, 2)
        assert got[i].kept_sha256 == hashlib.sha256(f"own {i}".encode()).hexdigest()
    assert got[6].n_dropped == 0 and got[None].n_dropped == 1
    assert (got[7].n_lines, got[7].kept_sha256) == (1, hashlib.sha256(b"").hexdigest()) == (got[8].n_lines, got[8].kept_sha256)
    assert got[10].n_dropped == got[11].n_dropped == 0
    assert line_dedup(frame(spark, [])).count() == 0


def test_line_dedup_many_lines(spark):
    common = [f"a common line with the number {k} and some more words" for k in range(150)]
    rows = [(i, "\n".join(common + [f"only {i} has this line, which is long enough too"])) for i in range(8)]
    got = {r.doc_id: r for r in line_dedup(frame(spark, rows)).collect()}
    assert [got[i].n_dropped for i in range(8)] == [150] * 7 + [0]
    assert got[0].kept_sha256 == hashlib.sha256(rows[0][1].split("\n")[-1].encode()).hexdigest()


def test_ngram_join_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for base in range(12):
        w = words(rng, rng.choice([20, 60, 200]))
        for copy in range(rng.choice([1, 2, 6])):
            v = list(w)
            for _ in range(copy // 2):
                v[rng.randrange(len(v))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows) * 3 + 1, " ".join(v)))
    w = words(rng, 100)
    for copy in range(30):  # more than a small group, one change each
        v = list(w)
        v[3 * copy % 100] = f"q{copy}"
        rows.append((len(rows) * 3 + 1, " ".join(v)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  two"), (None, "one two")]
    sets = {i: shingles(t) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    component = reach(sets, links)
    got = {r.doc_id: r for r in ngram_jaccard_join(frame(spark, rows), Forest(block=8, signature_block=8)).collect()}
    assert len(got) == len(rows) and got[None].kept and got[None].n_links == 0
    for i in sets:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], component[i], component[i] == i), i
    assert ngram_jaccard_join(frame(spark, [])).count() == 0


def test_forest_shortens_prefixes():
    f = Forest()
    assert estimated_recall([(47, 100.0)], f, 6) > estimated_recall([(40, 100.0)], f, 6)
    assert estimated_recall([(40, 100.0)], f, 6) < f.target_recall < estimated_recall([(40, 100.0)], f, 4)


def test_minima_do_not_depend_on_neighbours():
    rng = np.random.default_rng(2)
    sh = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
    alone = set(minima(sh[100:400], np.array([0, 300]), 35).tolist())
    at = np.array([0, 100, 400, 500])
    assert {x - 100 for x in minima(sh, at, 35).tolist() if 100 <= x < 400} == alone
    for i in range(300 - 35 + 1):  # every window has one
        assert any(i <= a < i + 35 for a in alone)


@pytest.mark.parametrize("size", [51, 80, 200])
def test_shared_passages_are_caught(spark, size):
    rng = random.Random(size)
    passages = [words(rng, size) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, "few words only")]
    holders = defaultdict(list)
    for i in range(3, 60):
        w = words(rng, 150)
        if i % 3 == 0:
            k = rng.randrange(150)
            w[k:k] = passages[i % 8]
            holders[i % 8].append(i)
        rows.append((i, " ".join(w)))
    spans = duplicate_spans(frame(spark, rows)).collect()
    hit = {r.doc_id for r in spans}
    assert hit == {i for v in holders.values() for i in v[1:]}
    texts = {r.doc_id: r.text for r in remove_spans(frame(spark, rows), duplicate_spans(frame(spark, rows))).collect()}
    for k, v in holders.items():
        assert sum(" ".join(passages[k]) in texts[i] for i in v) == 1
    assert texts[0] is None and texts[1] == "" and texts[4] == rows[4][1]
    assert duplicate_spans(frame(spark, [])).count() == 0


def test_cut_keeps_the_rest():
    assert cut("a b  c\nd e", [1], [3]) == "a d e"
    assert cut("a b", [0, 1], [1, 9]) == ""


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 16))
    near = base[:20].repeat(3, axis=0) + 0.25 * rng.standard_normal((60, 16))
    dense = base[50] + 0.2 * rng.standard_normal((40, 16))
    v = np.concatenate([base, near, dense]).astype(np.float32)
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [math.nan] + [1.0] * 15, 1), (903, [math.inf] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [], 1), (906, [1.0, 2.0], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    component = reach(range(len(v)), [(a, b) for a, b in zip(*np.nonzero(close))])
    got = {r.vec_id: r for r in vector_near_dedup(df).collect()}
    assert len(got) == len(rows) + len(bad)
    for i in range(len(v)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (close[i].sum(), component[i], component[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i, *_ in bad)
    assert vector_near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("size,edits", [(60, 1), (100, 2), (150, 3)])
def test_edited_passages_are_removed_whole(spark, size, edits):
    """Passages of Jaccard >= 0.8 with scattered changes, between words of their own."""
    rng = random.Random(size)
    rows, at, total = [], {}, 0
    for k in range(60):
        passage = words(rng, size, 10**6)
        for copy in range(2):
            v = list(passage)
            for e in range(edits * copy):
                v[(e + 1) * size // (edits + 1)] = f"z{rng.randrange(10**9)}"
            before, after = words(rng, 100, 10**6), words(rng, 100, 10**6)
            rows.append((2 * k + copy, " ".join(before + v + after)))
    gone = {i: 0 for i in range(1, 120, 2)}
    for r in duplicate_spans(frame(spark, rows)).collect():
        assert r.doc_id % 2 and r.kept_doc_id == r.doc_id - 1
        assert r.start_word >= 100 and r.end_word <= 100 + size
        gone[r.doc_id] += r.end_word - r.start_word
    assert sum(gone.values()) >= 0.95 * size * len(gone)


@pytest.mark.parametrize("window", [2, 12, 20, 35])
def test_minima_of_every_length(window):
    """Texts of 0 to 80 words, alone in a chunk: no crash, and exact copies share all minima."""
    rng = np.random.default_rng(window)
    for n in range(81):
        sh = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        got = minima(sh, np.array([0, n]), window)
        assert (len(got) > 0) == (n > 0)
        expect = {i + int(sh[i : i + window].argmin()) for i in range(max(1, n - window + 1))} if n else set()
        assert set(got.tolist()) == expect


def test_short_copies_alone_in_a_partition(spark):
    rng = random.Random(12)
    rows = []
    for n in (1, 5, 10, 15, 16, 17, 19, 23, 30, 48):
        text = " ".join(words(rng, n, 10**6))
        rows += [(2 * n, text), (2 * n + 1, text.upper())]
    df = frame(spark, rows).repartition(len(rows))
    hit = {r.doc_id: r for r in duplicate_spans(df).collect()}
    assert set(hit) == {2 * n + 1 for n in (16, 17, 19, 23, 30, 48)}
    assert all((r.start_word, r.end_word, r.kept_doc_id) == (0, i // 2, i - 1) for i, r in hit.items())
    # equal rows are one document, and rows of one doc_id are told apart
    again = frame(spark, [*rows[-2:], *rows[-2:], (rows[-1][0], "another text")])
    assert [(r.doc_id, r.end_word) for r in duplicate_spans(again).collect()] == [(97, 48)]
    assert sorted(str(r.text) for r in remove_spans(again, duplicate_spans(again)).collect()) == sorted(["", "", "another text", rows[-2][1], rows[-2][1]])


@pytest.mark.parametrize("size,edits,least", [(20, 0, 0.9), (24, 0, 1.0), (40, 0, 1.0), (60, 1, 1.0), (100, 2, 1.0), (200, 4, 1.0)])
def test_recall_of_passages(spark, size, edits, least):
    """Passages of Jaccard >= 0.8 between 100 words of other text on each side: the share of pairs found."""
    rng = random.Random(size)
    rows = []
    for k in range(100):
        passage = words(rng, size, 10**6)
        for copy in range(2):
            v = list(passage)
            for e in range(edits * copy):
                v[(e + 1) * size // (edits + 1)] = f"z{rng.randrange(10**9)}"
            rows.append((2 * k + copy, " ".join(words(rng, 100, 10**6) + v + words(rng, 100, 10**6))))
    found = {r.doc_id for r in duplicate_spans(frame(spark, rows)).collect()}
    assert len(found) >= least * 100 and all(i % 2 for i in found)


@pytest.mark.parametrize("noise", [0.0, 0.01])
def test_two_saturated_groups_find_each_other(spark, noise):
    """Groups of 30 near or exact copies at cosine 0.93: every vector's nearest are its own group's."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal(32)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(32)
    b -= a * (a @ b)
    b = 0.93 * a + (1 - 0.93**2) ** 0.5 * b / np.linalg.norm(b)
    v = np.concatenate([np.tile(x, (30, 1)) for x in (a, b)]) + noise * rng.standard_normal((60, 32)) / 32**0.5
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([v, rng.standard_normal((200, 32))]))]
    got = {r.vec_id: r for r in vector_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i].n_links for i in range(60)] == [59] * 60
    assert {got[i].component_id for i in range(60)} == {0} and sum(got[i].kept for i in range(60)) == 1


def test_vectors_many_copies_and_tables(spark):
    """One vector in a third of the rows; the tables grow with the bits."""
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1000)] + [(1000 + i, x.tolist()) for i, x in enumerate(rng.standard_normal((50, 4)))] + [(7, [1.0, 2.0, 3.0, 4.0])]
    got = vector_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    u = np.array([x for _, x in rows[1000:1050]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    extra = int((u @ (np.array([1.0, 2.0, 3.0, 4.0]) / 30**0.5) >= 0.9).sum())
    assert len(got) == len(rows) and {r.n_links for r in got if r.vec_id < 1000} == {999 + extra}
    p = Descent()
    assert 50 < p.tables(14) < p.tables(20) < p.tables(30) < 1500


def test_lines_with_clashing_columns(spark):
    line = "this is one long line which all of the documents have in common"
    schema = "doc_id long, text string, n_lines int, kept_text string, n_dropped int, words string, row string, `a.b` int"
    df = spark.createDataFrame([(i, f"own {i}\n{line}", 7, "k", 8, "w", "r", 9) for i in range(6)] + [(None, None, 7, "k", 8, "w", "r", 9)], schema)
    out = without_lines(df)
    assert out.schema == df.schema
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == "own 0" and got[5].text.endswith(line) and got[None].text is None
    assert all(tuple(r)[2:] == (7, "k", 8, "w", "r", 9) for r in got.values())


def test_hot_line_of_many_documents(spark):
    line = "this is one long line which nearly all of the documents have in common"
    rows = [(i, line) for i in range(3000)] + [(i, line) for i in range(5)]
    got = line_dedup(frame(spark, rows)).groupBy("n_dropped").count().collect()
    assert {r.n_dropped: r["count"] for r in got} == {1: 3004, 0: 1}
