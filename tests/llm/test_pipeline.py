"""The pipeline's stages against plain Python, and the registered queries against their SQL."""

import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from quireflow.llm.oracles import ORACLES
from quireflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def fixture_docs():
    rng = random.Random(11)

    def text(n):
        return "\n".join(" ".join(f"w{rng.randrange(20000)}" for _ in range(20)) for _ in range(n // 20))

    boiler = "this is a line of boilerplate that many of the documents share"
    passage = " ".join(f"p{k}" for k in range(70))
    rows = []
    for i in range(60):
        t = text(200)
        if i % 4 == 0:
            t += "\n" + boiler
        if i % 7 == 0:
            w = t.split("\n")
            w[3] += " " + passage + " tail"
            t = "\n".join(w)
        rows.append([i, t])
    rows += [[100 + k, rows[10 + k][1]] for k in range(4)]  # exact copies
    near = rows[21][1].split(" ")
    near[50] = "changed"
    rows += [[200, " ".join(near)], [300, "too short"], [301, "again and again " * 60], [302, None], [303, ""]]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], boiler, passage


def test_stages_against_plain_python(spark, tmp_path):
    rows, boiler, passage = fixture_docs()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, states = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        states[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == len(r.text) for r in states[name])
    kept = {i: t for i, t, *_ in rows if i < 300}
    assert {r.doc_id for r in states["quality_rules"]} == set(kept)
    holders = [i for i, t in kept.items() if boiler in t.split("\n")]
    expect = {i: "\n".join(x for x in t.split("\n") if x != boiler or i == max(holders)) for i, t in kept.items()}
    assert {r.doc_id: r.text for r in states["line_dedup"]} == expect
    assert {r.doc_id for r in states["ngram_jaccard_join"]} == set(kept) - {100, 101, 102, 103, 200}
    texts = {r.doc_id: r.text for r in states["substring_dedup"]}
    assert sum(passage in t for t in texts.values()) == 1 and passage in texts[0]
    assert all(texts[i] == expect[i] for i in texts if passage not in expect[i])
    size = Counter()
    bins = defaultdict(list)
    for r in states["best_fit_packing"]:
        size[r.doc_id] += r.n_words
        bins[r.bin_id].append((r.doc_id % 3, r.n_words))
    assert size == {i: len(t.split()) for i, t in texts.items()}
    assert all(sum(n for _, n in v) <= 2048 and len({s for s, _ in v}) == len(v) for v in bins.values())
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, states["best_fit_packing"]))


def test_stages_keep_other_columns_and_empty_tables(spark, tmp_path):
    """Extra columns under the names that stages use inside come through unchanged; an empty table goes through all stages."""
    rows, boiler, passage = fixture_docs()
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, kept_text string, n_dropped int, sp_from int, row string, words string, stratum string"
    more = [(*r, 7, "k", 8, 9, "r", "w", "x") for r in rows] + [(None, None, None, None, None, 7, "k", 8, 9, "r", "w", "x")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, data in (("full", more), ("empty", [])):
        docs = spark.createDataFrame(data, schema)
        for stage, work in corpus_pipeline.STAGES[:-1]:
            work(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{stage}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
            assert docs.where("not (n_lines = 7 and kept_text = 'k' and n_dropped = 8 and sp_from = 9 and row = 'r' and words = 'w' and stratum = 'x')").isEmpty()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert (last.count() > 0) == bool(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    db.execute(f"CREATE TABLE o AS {ORACLES[name]}")
    names = ", ".join(sorted(r[0] for r in db.execute("DESCRIBE o").fetchall()))
    for a, b in (("o", f"'{tmp_path}/out/*.parquet'"), (f"'{tmp_path}/out/*.parquet'", "o")):
        assert not db.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b}").fetchall()
    assert db.execute("SELECT count(*) FROM o").fetchone()[0] > 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
