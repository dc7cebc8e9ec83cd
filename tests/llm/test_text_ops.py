"""Quality rules, language, packing, chat, pieces and HTML on small fixtures."""

import json
import random
import time
from collections import Counter, defaultdict
from math import comb

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.llm.chat import canonical, chat_format, violations
from quireflow.llm.html_text import Boilerplate, blocks, html_text, shared_runs
from quireflow.llm.language_id import Trees, language_id
from quireflow.llm.line_dedup import line_dedup
from quireflow.llm.ngram_join import ngram_jaccard_join
from quireflow.llm.oracles import ORACLES
from quireflow.llm.packing import Bins, best_fit_packing, pack_shard, packing_items
from quireflow.llm.pieces import Batch, Lattice, Sampling, Vocabulary, decode, piece_ids, sample_pieces, top_k
from quireflow.llm.queries import QUERIES
from quireflow.llm.quality import Risk, kept_documents, log_binomial_cdf, measures, quality_rules
from quireflow.llm.substring_dedup import duplicate_spans, remove_spans

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def repeated_words(text):
    w = text.replace("\x0b", " ").split()
    n = Counter(zip(w, w[1:], w[2:]))
    return len({j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_measures_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["", " ", "a b c a b c", "x x x x x x", "a\na\n\n b\na", "#1 *2* $ <b>", "É é Ü"] + [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(80))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate([*texts, None])], "doc_id long, text string, lang string")
    for r in measures(df).collect():
        t = [*texts, ""][r.doc_id]
        lines = [x for x in t.split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(t.split()), sum(map(len, t.split())), repeated_words(t)), t
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_symbols == sum(c in "#*$%&|<>" for c in t)


def test_binomial_bound(spark):
    cases = [(0, 10, 0.1), (3, 40, 0.05), (7, 500, 0.01), (20, 5000, 0.01)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    got = [r[0] for r in df.select(F.exp(log_binomial_cdf(F.col("k"), F.col("n"), F.col("p")))).collect()]
    for (k, n, p), x in zip(cases, got):
        assert x == pytest.approx(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


def test_quality_rules_keep_good_and_drop_junk(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(3000):
        w = [f"word{rng.randrange(5000)}" for _ in range(80)]
        if i % 5 == 0:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w), "en"))
        if i % 2:
            labels.append((i, int(i % 5 != 0)))
    docs += [(5000, None, None), (5001, "", "en"), (5002, "few", "xx")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    q = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(d, q, Risk(max_rate=0.2)).collect()}
    assert all(got[i].kept == (i % 5 != 0) for i in range(3000))
    assert not any(got[i].kept for i in (5000, 5001, 5002))
    few = {r.doc_id: r.kept for r in quality_rules(d, q.limit(3)).collect()}
    assert all(few[i] for i in range(3000))  # too few labels certify nothing
    assert quality_rules(d.limit(0), q).count() == 0


def test_language_by_held_out_accuracy(spark):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "ro", "mi"], "bb": ["schn", "elt", "üf"], "cc": ["qu", "est", "où"]}
    rows = []
    for i in range(300):
        lang = "aa bb cc".split()[i % 3]
        rows.append((i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(12)), lang))
    rows += [(1000, None, "aa"), (1001, "123 !", "aa"), (1002, "karomi", None), (None, "schnelt", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows[:300]) and any(got[i].held_out for i in range(300))
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[1002].lang_pred == "aa" and got[None].lang_pred == "bb" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id(df.limit(0)).count() == 0
    assert language_id(df.where("lang is null")).first().lang_pred == "und"


def best_fit(items, capacity):
    """Plain best fit: scan all bins for the tightest compatible one."""
    bins, out = [], {}
    for row in sorted(range(len(items)), key=lambda r: (-(items[r][1] % capacity), items[r][0])):
        _, size, source, cluster = items[row]
        for _ in range(size // capacity):
            bins.append([0, set(), set()])
        rest = size % capacity
        if not rest:
            continue
        fits = [b for b in bins if b[0] >= rest and source not in b[1] and cluster not in b[2]]
        room = min((b[0] for b in fits), default=None)
        out[row] = room
        b = next((b for b in fits if b[0] == room), None)
        if b is None:
            b = [capacity, set(), set()]
            bins.append(b)
        b[0] -= rest
        b[1].update({source} - {-1})
        b[2].update({cluster} - {-1})
    return len(bins)


def test_packing_is_best_fit(spark):
    rng = random.Random(7)
    items = [(i, rng.randrange(1, 400), rng.randrange(-1, 6), rng.randrange(-1, 40)) for i in range(300)]
    placed = pack_shard(*(np.array([x[k] for x in items]) for k in range(4)), 256)
    assert len({p[2] for p in placed}) == best_fit(items, 256)
    content = defaultdict(list)
    for row, _, b, start, size, at in placed:
        content[b].append((at, size, items[row][2], items[row][3]))
    for v in content.values():
        v.sort()
        assert all(a + s <= b for (a, s, *_), (b, *_) in zip(v, v[1:])) and v[-1][0] + v[-1][1] <= 256
        for k in (2, 3):
            some = [x[k] for x in v if x[k] >= 0]
            assert len(some) == len(set(some))
    total = Counter()
    for row, _, _, _, size, _ in placed:
        total[row] += size
    assert total == {i: x[1] for i, x in enumerate(items)}


def test_packing_edges(spark):
    rows = [(1, 10, "a", 1), (2, None, "a", 1), (3, 0, None, None), (None, 5, "b", 2), (4, 300, "a", 3), (4, 300, "a", 3)]
    df = spark.createDataFrame(rows, "doc_id long, n_words long, source string, cluster long")
    got = best_fit_packing(df, Bins(capacity=100, shard_rows=2)).collect()
    assert Counter(r.doc_id for r in got) == {1: 1, 2: 1, 3: 1, None: 1, 4: 6}
    assert all((r.bin_id is None) == (r.doc_id in (2, 3)) for r in got)
    assert best_fit_packing(df.limit(0)).count() == 0


def test_schemas():
    schema = {"type": "object", "required": ["q"], "properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 1}}, "additionalProperties": False}
    assert violations({"q": "x", "n": 2}, schema) == []
    assert violations({"q": "", "n": 0.5, "z": 1}, schema) == ["$.n: not integer", "$.q: too short", "$.z: unexpected"]
    assert violations([], schema) == ["$: not object"] and violations({"n": True}, schema) == ["$.q: missing", "$.n: not integer"]
    assert canonical({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'


def test_chat_links_and_orders(spark):
    def call(*ids, needs=None):
        return json.dumps({"content": "x", "tool_calls": [{"id": i, "name": "find", "arguments": {"q": "a"}, "depends_on": needs or []} for i in ids]})

    def result(i):
        return json.dumps({"tool_call_id": i, "content": "ok"})

    rows = [
        (1, 0, "user", "hello"), (1, 1, "tool", result("a")), (1, 2, "assistant", call("a")), (1, 3, "assistant", call("b", needs=["c"])), (1, 4, "assistant", call("c")), (1, 5, "tool", result("c")), (1, 6, "tool", result("b")),
        (2, 0, "assistant", call("a", "a")), (2, 1, "tool", result("zz")), (2, 2, "assistant", "{broken"), (2, None, None, None), (None, 0, "tool", result("a")),
        (3, 0, "assistant", call("p", needs=["q"])), (3, 1, "tool", result("p")), (3, 2, "assistant", call("q", needs=["p"])), (3, 3, "tool", result("q")),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format(df, {"find": {"type": "object", "required": ["z"]}}, max_depth=12).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    order = [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_depth, r.turn))]
    assert order.index(2) < order.index(1) and order.index(4) < order.index(5) < order.index(3) < order.index(6)
    assert by[1, 2].linked and by[1, 1].linked and by[1, 0].linked is None
    assert by[2, 0].problems[:2] == ["duplicate_call", "no_result"] and by[2, 1].problems == ["orphan_result"] and not by[2, 1].linked
    assert "a: $.z: missing" in by[1, 2].problems
    assert any("cycle" in r.problems for r in got if r.conv_id == 3)
    assert json.loads(by[1, 1].message) == {"role": "tool", "tool_call_id": "a", "content": "ok"}
    assert by[2, 2].message == '{"content":"{broken","role":"assistant"}' and by[2, None].message == '{"content":null,"role":null}'
    assert chat_format(df.limit(0)).count() == 0


def test_chat_places_long_chains_and_marks_whole_cycles(spark):
    def call(i, *needs):
        return json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {}, "depends_on": list(needs)}]})

    def result(i):
        return json.dumps({"tool_call_id": i})

    n = 20  # a chain in reverse: every call needs the result of the next
    rows = [(1, 2 * (n - k), "assistant", call(f"c{k}", *([f"c{k - 1}"] if k else []))) for k in range(n)]
    rows += [(1, 2 * (n - k) + 1, "tool", result(f"c{k}")) for k in range(n)]
    rows += [(2, 0, "assistant", call("p", "q")), (2, 1, "tool", result("p")), (2, 2, "assistant", call("q", "p")), (2, 3, "tool", result("q")), (2, 4, "assistant", call("r", "q")), (2, 5, "tool", result("r"))]
    got = chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), max_depth=3).collect()
    chain = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_depth, r.turn))
    assert [r.turn for r in chain] == [2 * (n - k) + d for k in range(n) for d in (0, 1)]
    assert not any("cycle" in r.problems for r in chain)
    marked = {r.turn: "cycle" in r.problems for r in got if r.conv_id == 2}
    assert marked == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}
    assert all((r.order_turn, r.order_depth) == (r.turn, 0) for r in got if r.conv_id == 2)


@pytest.fixture(scope="module")
def lattice():
    return Lattice(Vocabulary.load(PIECES), 50.0)


def test_pieces_round_trip_and_are_distinct(lattice):
    texts = ["", "a", " two  spaces ", "line\nbreak\t", "▁ literal", "日本 😀", "hello world " * 20, "x" * 3000, "é"]
    batch = Batch(lattice, texts)
    paths, logs, values, _ = top_k(batch, np.arange(len(texts), dtype=np.uint64), 3)
    seen = defaultdict(set)
    for path, log, value in zip(paths, logs, values):
        ids, at = piece_ids(path)
        for d, t in enumerate(texts):
            if np.isfinite(value[d]):
                mine = tuple(ids[at[d] : at[d + 1]].tolist())
                assert (decode(mine, lattice.vocabulary) if mine else "") == t
                assert mine not in seen[d] and log[d] <= 1e-9
                seen[d].add(mine)
    assert len(seen[0]) == 1 and len(seen[6]) == 3
    assert all(a >= b for a, b in zip(values[:, 6], values[1:, 6]))


def test_samples_follow_the_lattice(lattice):
    """First samples come with their probabilities, and pairs as sampling without replacement has them."""
    n = 6000
    batch = Batch(lattice, ["abc"] * n)
    paths, logs, values, threshold = top_k(batch, np.arange(n, dtype=np.uint64) * np.uint64(7919), 2)
    first, pairs, p = Counter(), Counter(), {}
    ids = [piece_ids(x) for x in paths]
    for d in range(n):
        names = [tuple(i[at[d] : at[d + 1]].tolist()) for i, at in ids]
        p |= {names[0]: np.exp(logs[0][d]), names[1]: np.exp(logs[1][d])}
        first[names[0]] += 1
        pairs[tuple(names)] += 1
    for name, count in first.items():
        assert abs(count / n - p[name]) < 5 * (p[name] * (1 - p[name]) / n) ** 0.5 + 1e-3
    for (a, b), count in pairs.items():
        q = p[a] * p[b] / (1 - p[a])
        assert abs(count / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-3
    assert (values[1] <= values[0]).all() and (threshold <= values[1]).all()


def test_sample_pieces_table(spark):
    vocabulary = Vocabulary.load(PIECES)
    df = spark.createDataFrame([(1, "some words here"), (1, "some words here"), (2, None), (3, ""), (None, "x y")], "doc_id long, text string")
    got = sample_pieces(df, vocabulary, Sampling(k=3)).collect()
    assert Counter(r.doc_id for r in got) == {1: 6, 2: 1, 3: 1, None: 3}
    assert all(r.log_inclusion <= 1e-12 for r in got) and len({tuple(r.ids) for r in got if r.doc_id == 1}) == 3
    again = sample_pieces(df.repartition(3), vocabulary, Sampling(k=3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sample_pieces(df.limit(0), vocabulary).count() == 0


PAGE = '<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{}<footer>&copy; site</footer></body></html>'


def test_blocks():
    page = PAGE.format('<article><header><h1>Big &lt;title&gt;</h1></header><p><b>One   two&nbsp;three.<br><p>Four<p>Five<div class="share-bar">Share</div><aside>Side</aside><form><input>Go</form><div class="comments"><p>Nice</p></div><table><tr><td>a<td>b</table></article>')
    main = [t for k, t in blocks(page) if k == 2]
    assert main == ["Big <title>", "One two three.", "Four", "Five", "a", "b"]
    assert blocks("") == [] and blocks("just text &amp; more") == [(1, "just text & more")]
    assert blocks("<p>a<script>x") == [(1, "a")] and blocks("a < b <") != []


def test_suffix_array_counts_pages():
    rng = np.random.default_rng(8)
    tokens = rng.integers(0, 4, 200)
    page = np.repeat(np.arange(5), 40)
    counts, order = shared_runs(tokens, page, 3)
    grams = defaultdict(set)
    for i in range(200):
        if i + 3 <= 40 * (page[i] + 1):
            grams[tuple(tokens[i : i + 3])].add(page[i])
    for i in range(200):
        inside = i + 3 <= 40 * (page[i] + 1)
        assert counts[i] == (len(grams[tuple(tokens[i : i + 3])]) if inside else 0)
    assert sorted(order.tolist()) == list(range(200))


def test_html_text_removes_shared_blocks(spark):
    rng = random.Random(9)
    notice = "All rights reserved by the owners of this site and their friends"
    rows = []
    for i in range(20):
        own = " ".join(f"w{rng.randrange(9999)}" for _ in range(30))
        rows.append((i, f"http://h.example/{i}", f"<body><div>{notice}</div><div>{own}</div></body>", own))
    copy = " ".join(f"c{k}" for k in range(40))
    rows += [(100 + i, f"http://k.example/{i}", PAGE.format(f"<article><p>{copy}</p></article>"), copy) for i in range(15)]
    rows += [(200, None, None, ""), (201, "", "", "")]
    df = spark.createDataFrame([(*r[:3], "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html_text(df).collect()}
    assert len(got) == len(rows)
    for i, _, _, text in rows:
        assert (got[i].text, got[i].n_chars) == (text, len(text))
    assert html_text(df.limit(0)).count() == 0


def test_html_text_does_not_depend_on_shards(spark):
    """A passage on three pages of a host goes from all of them, in however many shards they lie; equal pages count as one."""
    rng = random.Random(10)
    rows = []
    for i in range(60):
        own = " ".join(f"w{rng.randrange(99999)}" for _ in range(30))
        third = " ".join(f"p{i % 20}x{k}" for k in range(12))  # on three pages
        rows.append((i, f"http://h.example/{i}", f"<body><div>{third}</div><div>{own}</div></body>"))
    copy = " ".join(f"c{k}" for k in range(40))
    rows += [(100 + i, f"http://h.example/c{i}", f"<body><div>{copy}</div></body>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, cut = ({r.page_id: r.text for r in html_text(df, Boilerplate(shard_pages=n)).collect()} for n in (256, 8))
    assert whole == cut and len(cut) == len(rows)
    assert not any("x" in cut[i] for i in range(60)) and cut[100] == copy


def test_array_decides_and_markup_follows(spark):
    """Without markup the array finds menus and notices; switched off, they stay. Markup takes what repeats nowhere."""
    rng = random.Random(13)

    def own(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    menu = "".join(f"<li>{x}</li>" for x in ("Home", "News", "Sport", "Contact"))
    rows = []
    for i in range(12):
        body = own(40)
        rows.append((i, f"http://h.example/{i}", f"<body><ul>{menu}</ul><div>{body}</div><div>Copyright of the site and of all its owners for ever</div><div class='ad'>{own(5)}</div></body>", body))
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text(df).collect()}
    off = {r.page_id: r for r in html_text(df, Boilerplate(pages=10**6, template_pages=10**6)).collect()}
    for i, _, _, body in rows:
        assert got[i].text == body and (got[i].n_by_array, got[i].n_by_markup) == (5, 1)
        assert "Home" in off[i].text and off[i].n_by_array == 0


def test_teasers_names_and_notices_in_articles(spark):
    rng = random.Random(14)

    def own(n):
        return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))

    teaser, body, section, work = own(10), own(60), own(30), own(20)
    rows = [(0, "http://a.example/0", f"<article><p>{teaser}</p></article><div><p>{body}</p></div>", f"{teaser}\n{body}")]
    rows.append((1, "http://b.example/1", f"<article><section class='search-algorithms'>{section}</section><div class='related-work'>{work}</div><article class='comment'>{own(9)}</article></article>", f"{section}\n{work}"))
    notice = "Subscribe to the letter that we send to all of our readers"
    for i in range(10, 16):
        text = own(40)
        rows.append((i, f"http://c.example/{i}", f"<article><p>{text}</p><p>{notice}</p></article>", text))
    got = {r.page_id: r.text for r in html_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_html_text_of_large_hosts_and_many_copies(spark):
    """A host of 5,000 pages in 20 shards, one page of which stands in a third of the rows."""
    rows = [(i, f"http://h.example/{i}", f"<body><p>{' '.join(f'x{i}y{k}' for k in range(12))}</p><p>{' '.join(f'p{i % 1000}x{k}' for k in range(10))}</p></body>") for i in range(3000)]
    rows += [(10000 + i, "http://h.example/copy", "<body><p>one page which is here many times over and over again</p></body>") for i in range(2000)]
    got = {r.page_id: r.text for r in html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 5000 and all(got[i] == " ".join(f"x{i}y{k}" for k in range(12)) for i in range(3000))
    assert {got[i] for i in range(10000, 12000)} == {"one page which is here many times over and over again"}


def test_blocks_take_linear_time():
    for make in (lambda n: "<b>" * n + "</i>" * n, lambda n: "<p><b>x" * n, lambda n: "<a title='x>" * n):
        began = time.perf_counter()
        blocks(make(30000))
        assert time.perf_counter() - began < 20


def test_messages_that_are_not_unicode(spark):
    text = '{"tool_call_id": "a", "content": "\\ud800"}'
    calls = '{"tool_calls": [{"id": "\\ud800", "name": "f", "arguments": {"\\udfff": 1}}, {"id": null, "name": "f"}, {"id": null, "name": "f"}]}'
    df = spark.createDataFrame([(1, 0, "tool", text), (1, 1, "assistant", calls), (None, None, None, None), (1, 2, "user", "[" * 5000)], "conv_id long, turn int, role string, text string")
    got = {r.turn: r for r in chat_format(df, {"f": {"additionalProperties": False}}).collect()}
    assert json.loads(got[0].message) == {"role": "tool", "content": text} and "message: not Unicode" in got[0].problems
    assert json.loads(got[1].message)["content"] == calls and got[1].n_calls == 3 and "duplicate_call" not in got[1].problems
    assert json.loads(got[None].message) == {"content": None, "role": None}


def test_rules_certify_on_small_strata(spark):
    """100 good documents in the certifying half are enough for cutoffs that reject none of them; 60 are not."""
    rng = random.Random(15)
    docs, labels = [], []
    for lang, good in (("big", 260), ("small", 90)):
        for k in range(good + 120):
            w = [f"word{rng.randrange(5000)}" for _ in range(80)]
            docs.append((len(docs), " ".join(x + "###" if k >= good else x for x in w), lang))
            labels.append((docs[-1][0], int(k < good)))
    d, q = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(d, q).collect()}
    bad = {i for i, x in labels if not x}
    assert all(got[i].kept == (i not in bad) for i, _, lang in docs if lang == "big")
    assert all(got[i].kept for i, _, lang in docs if lang == "small")


def test_rules_equal_their_sql_where_cutoffs_are_certified(spark, tmp_path):
    rng = random.Random(16)
    docs, labels = [], []
    for i in range(1500):
        w = [f"word{rng.randrange(5000)}" for _ in range(80)]
        for _ in range(rng.choice([0, 0, 0, 1, 5, 30])):
            w[rng.randrange(80)] += rng.choice(["###", "!", "ABC", "$"])
        docs.append((i, " ".join(w), rng.choice(["en", "de", None])))
        labels.append((i, int(sum(x.count("#") for x in w) < 9), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(map(tuple, QUERIES["op7_quality_rules"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(db.execute(ORACLES["op7_quality_rules"]).fetchall())
    assert 100 < sum(not r[-1] for r in got) < 700 and not any(r[-2] for r in got)


def test_packing_deals_repeated_items(spark):
    rows = [(1, 100, "s", "c")] * 9000 + [(i, 50, f"s{i % 7}", None) for i in range(2, 500)]
    got = best_fit_packing(spark.createDataFrame(rows, "doc_id long, n_words long, source string, cluster string"), Bins(shard_rows=1000)).collect()
    assert len(got) == len(rows)
    assert len({r.bin_id for r in got if r.doc_id == 1}) == 9000
    assert len({r.bin_id >> 32 for r in got if r.doc_id == 1}) > 5


def segmentations(text, vocabulary):
    """All segmentations of a text and their probabilities, by plain recursion over the list of pieces."""
    usable = [p for p, ok in zip(vocabulary.pieces, vocabulary.usable) if ok and p]
    weight = {p: 1 / (rank + 50) for rank, p in enumerate(usable)}
    ids = {p: i for i, (p, ok) in enumerate(zip(vocabulary.pieces, vocabulary.usable)) if ok and p}

    def ways(rest):
        if not rest:
            return [((), 1.0)]
        out = []
        for n in range(1, len(rest) + 1):
            if rest[:n] in weight:
                out += [((ids[rest[:n]], *path), weight[rest[:n]] * w) for path, w in ways(rest[n:])]
        return out

    found = ways("\u2581" + text.replace(" ", "\u2581"))
    total = sum(w for _, w in found)
    return {path: w / total for path, w in found}


@pytest.mark.parametrize("text", ["abc", "the cat", "hello"])
def test_samples_against_an_enumerated_lattice(lattice, text):
    """Every sample is a segmentation there is, with its exact probability; first and second ones come as often as they should."""
    exact = segmentations(text, lattice.vocabulary)
    n = 4000
    batch = Batch(lattice, [text] * n)
    paths, logs, _, _ = top_k(batch, np.arange(n, dtype=np.uint64) * np.uint64(104729), 2)
    ids = [piece_ids(x) for x in paths]
    first, second = Counter(), Counter()
    for d in range(n):
        one, two = (tuple(i[at[d] : at[d + 1]].tolist()) for i, at in ids)
        assert one != two and np.exp(logs[0][d]) == pytest.approx(exact[one], rel=1e-6) and np.exp(logs[1][d]) == pytest.approx(exact[two], rel=1e-6)
        first[one] += 1
        second[two] += 1
    for path, p in exact.items():
        q = sum(exact[o] * p / (1 - exact[o]) for o in exact if o != path)
        for count, chance in ((first[path], p), (second[path], q)):
            assert abs(count / n - chance) < 5 * (chance * (1 - chance) / n) ** 0.5 + 1e-3


def test_code_lengths_against_brute_force():
    """The trees' code lengths equal those of dictionaries of counts: escape to the next shorter context with distinct / (total + distinct)."""
    rng = random.Random(17)
    learned = {"x": ["".join(rng.choice("abcd ") for _ in range(200)), "abab"], "y": ["".join(rng.choice("cdef ") for _ in range(150))]}
    least, depth = 3, 4
    rows, contexts, together = Counter(), defaultdict(lambda: defaultdict(Counter)), Counter()
    for lang, texts in learned.items():
        for t in texts:
            raw = b"\n" * depth + t.encode()
            for i in range(depth, len(raw)):
                rows[lang, int.from_bytes(raw[i - depth : i + 1], "big")] += 1
                for order in range(depth + 1):
                    together[raw[i - order : i]] += 1
                    contexts[lang][raw[i - order : i]][raw[i]] += 1

    def bits(lang, context, symbol):
        p = 1.0
        while True:
            n = contexts[lang].get(context)
            if n and (len(context) < 3 or together[context] >= least):
                total, distinct = sum(n.values()), len(n)
                if n[symbol]:
                    return -np.log2(p * n[symbol] / (total + distinct))
                p *= distinct / (total + distinct)
            if not context:
                return -np.log2(p / 256)
            context = context[1:]

    langs = sorted(learned)
    keys = sorted(rows)
    trees = Trees(2, np.array([langs.index(k[0]) for k in keys]), np.array([k[1] for k in keys]), np.array([rows[k] for k in keys]), depth, least)
    texts = ["abcd", "zzz a", "", "fed cab " * 9, "\u00e9"]
    raw = [t.encode() for t in texts]
    got = trees.lengths(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, mine in zip(raw, got):
        padded = b"\n" * depth + t
        expect = [sum(bits(lang, padded[i - depth : i], padded[i]) for i in range(depth, len(padded))) for lang in langs]
        assert mine == pytest.approx(expect, rel=1e-4)


def test_clashing_columns_and_repeats_everywhere(spark):
    """Extra columns under the names of helpers, repeated rows and nulls: same results as without, row by row."""
    rng = random.Random(18)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 60, 120]))), "en", "s") for i in range(30)]
    rows += [rows[3], rows[3], (None, None, None, None), (31, "", None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["row", "t", "w", "shard", "copy", "copies", "n_words", "cluster", "sig", "node", "key", "at", "kept", "stratum", "letters", "held_out", "msg", "place", "text_hash", "n_sh"]
    clash = plain.select("*", *(F.lit("clash").alias(n) for n in names))
    labels = spark.createDataFrame([(i, i % 2, 0, "c") for i in range(30)], "doc_id long, quality int, toxic int, row string")
    for op in (lambda d: quality_rules(d, labels), language_id, lambda d: best_fit_packing(packing_items(d)).select("doc_id", "piece", "n_words"), ngram_jaccard_join, lambda d: duplicate_spans(d).select("doc_id", "start_word", "end_word"), line_dedup, lambda d: kept_documents(d, labels).select("doc_id", "text")):
        assert sorted(map(str, op(plain).collect())) == sorted(map(str, op(clash).collect()))
        assert op(clash.limit(0)).count() == 0
    assert kept_documents(clash, labels).columns == clash.columns
    assert remove_spans(clash, duplicate_spans(clash)).columns == clash.columns
    got = ngram_jaccard_join(plain).where("doc_id = 3").collect()
    assert len(got) == 3 and len(set(got)) == 1 and got[0].n_links == 2
