"""Queries over a book of more pages than four digits, or an int of elements, can number."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quireflow import params as P
from quireflow.functions import text as T
from quireflow.operators.repeated import alike, merged_keys
from quireflow.plans.oracles import ORACLES
from quireflow.plans.queries import QUERIES, _noted
from quireflow.sources import pdf

PAGES = 21_600


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("large"))
    long = "repeat('long line of a giant chapter' || chr(10), 200)"
    duckdb.execute(f"COPY (SELECT i AS doc_id, CASE WHEN i < 10 OR i > {PAGES - 10} THEN {long} ELSE 'short page' END AS text, 'en' AS lang, 'b' || (i % 50 = 7)::INT AS source, 10::BIGINT AS n_chars FROM range({PAGES * 51 // 50}) t(i)) TO '{folder}/documents.parquet'")
    return folder


def compared(spark, folder, out, name, wide=False):
    """Schema in Spark, and the rows of both; ``wide`` lets the SQL number elements beyond an int."""
    df = QUERIES[name](spark, folder)
    df.write.parquet(f"{out}/{name}")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    sql = ORACLES[name].replace("page_no * 100000", "CAST(page_no AS BIGINT) * 100000") if wide else ORACLES[name]
    db.execute(f"CREATE TABLE o AS {sql}")
    names = ", ".join(sorted(df.columns))
    spark_rows, sql_rows = (f"SELECT {names} FROM {x}" for x in (f"'{out}/{name}/*.parquet'", "o"))
    for a, b in ((spark_rows, sql_rows), (sql_rows, spark_rows)):
        assert not db.execute(f"SELECT * FROM ({a} EXCEPT ALL {b}) LIMIT 3").fetchall()
    assert db.execute("SELECT count(*) FROM o").fetchone()[0] > 0
    return dict(df.dtypes), db


@pytest.mark.parametrize("name", ["footnote_split", "footnote_refs"])
def test_page_numbers_of_five_digits_are_no_notes(spark, large, tmp_path, name):
    compared(spark, large, tmp_path, name)


def test_notes_of_null_books_and_pages_with_lines_like_the_citing_one(spark, tmp_path):
    texts = ["NULL", "''", "'a' || chr(10) || 'as said before' || chr(10) || '(as said'", "'(1) x' || chr(10) || '2- y'", "'12' || chr(10) || '- 5 -'"]
    made = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts))
    duckdb.execute(f"COPY (SELECT i AS doc_id, CASE i % 5 {made} END AS text, 'en' AS lang, CASE WHEN i % 3 > 0 THEN 'b' || i % 3 END AS source, 10::BIGINT AS n_chars FROM range(60) t(i)) TO '{tmp_path}/documents.parquet'")
    kinds, db = compared(spark, str(tmp_path), tmp_path, "footnote_refs")
    assert db.execute("SELECT count(*) FROM o WHERE book_id IS NULL AND text LIKE '%[^p%'").fetchone()[0] == 10


def test_pages_with_notes_are_split_once(spark, large):
    plan = _noted(spark, large)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate posexplode")
    assert "split(" not in above and below.count("split(") == 1


def test_giant_split_beyond_int(spark, large, tmp_path):
    kinds, db = compared(spark, large, tmp_path, "giant_split", wide=True)
    assert kinds["elem_no"] == "bigint" and db.execute("SELECT max(elem_no) > 2147483647, max(part_no) > 0 FROM o").fetchone() == (True, True)


def test_giant_titles_beyond_int(spark, large, tmp_path):
    compared(spark, large, tmp_path, "giant_titles", wide=True)


def test_keys_merge_as_by_all_comparisons():
    rng = random.Random(5)
    made = [str(n) for n in range(9_000, 11_000, 3)] + [f"httpsbooks{n}" for n in range(0, 300, 7)]
    for letters in ("abc", "etaoinshrdlu", "".join(map(chr, range(0x4E00, 0x4E80)))):
        for _ in range(40):
            key = "".join(rng.choices(letters, k=rng.choice([4, 9, 20, 40, 63, 64, 65, 90])))
            made += [key, key[:3] + key[4:], key + rng.choice(letters), "".join(rng.sample(key, len(key))), key[2:] + key[:2]]
    rng.shuffle(made)
    keys = list(dict.fromkeys(made))
    for r in (P.Repeated(), P.Repeated(fuzzy=0.6, max_key_gap=9)):
        alone, want = [], []
        for key in keys:
            found = next((k for k in alone if abs(len(k) - len(key)) <= r.max_key_gap and alike(k, key, r.fuzzy)), key)
            alone += [key] if found == key else []
            want.append(found)
        assert merged_keys(keys, r) == want


def test_many_page_numbers_merge_in_time():
    from time import process_time

    keys = [str(n) for n in range(10_000, 40_000, 3)]
    began = process_time()
    assert merged_keys(keys) == keys
    assert process_time() - began < 60


def test_bounded_word_counts_and_ends(spark):
    rng = random.Random(7)
    texts = [None, "", " ", "\u2029", "a", "a.", "\U00020000\u061f ", "x" * 70_000, "x\u3000" * 70_000]
    texts += ["".join(rng.choices(["a", "bc", "\U00020000", ".", " ", "\n", "\x1c", "\x85", "\xa0", "\u2028", "\u061f"], k=rng.randrange(1, 45))) for _ in range(3_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    bare = T.strip(F.col("t"))
    for low, high in ((1, 8), (3, 16)):
        assert not rows.where(~T.words_between(F.col("t"), low, high).eqNullSafe(T.words(F.col("t")).between(low, high))).count()
    assert not rows.where(~T.ends_terminal(bare).eqNullSafe(bare.rlike(f"[{P.TERMINAL}]$"))).count()
    assert not rows.where(~T.unterminated(F.col("t")).eqNullSafe(bare.rlike(f"[^{P.TERMINAL}]$"))).count()


def _pdf(body):
    font = "/Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R"
    kinds = [f"3 0 obj << {font} >>", "4 0 obj << /Type /Font /BaseFont /A-Bold /DW 480 /W [97 [250 333.3 612.7]] >>", "5 0 obj << >>\nstream\n1 beginbfrange\n<0020> <06FF> <0020>\nendbfrange\n1 beginbfchar\n<0041> <00660066>\nendbfchar\nendstream"]
    page = ["1 0 obj << /Type /Catalog /Pages 2 0 R >>", "2 0 obj << /Type /Pages /Kids [6 0 R] >>", "6 0 obj << /Type /Page /Resources << /Font << /F1 3 0 R >> >> /Contents 7 0 R >>"]
    return ("%PDF-1.4\n" + "\nendobj\n".join([*kinds, *page, f"7 0 obj << >>\nstream\n{body}\nendstream"]) + "\nendobj\ntrailer << /Root 1 0 R >>").encode()


def test_runs_give_what_glyphs_give(monkeypatch):
    rng = random.Random(3)
    files = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            text = "".join(rng.choices(rng.choice(["abcdefgh  ", "abcABC \xe9", "\u0633\u0644\u0627\u0645 ab1 ", "\u2603ab "]), k=rng.choice([0, 3, 8, 30]))).encode("utf-16-be").hex()
            parts.append(f"{rng.choice(['', 'q .7 0 0 .9 1 1 cm', 'q 0 1 1 0 0 0 cm'])} BT /F1 {rng.choice([10, 7.3, 0.5, -9])} Tf {rng.choice(['', '1.3 Tc', '4 Tc', '-7 Tc', '80 Tz', '2 Ts'])} {rng.choice(['1 0 0 1', '1.5 0 .2 1.2', '0 1 -1 0', '-1 0 0 1'])} {rng.choice([20, 33.3, 150])} {rng.choice([20, 34, 34.02])} Tm <{text}> Tj ET {rng.choice(['', 'Q'])}")
        files.append(_pdf("\n".join(parts)))
    files.append(_pdf("\n".join(f"BT /F1 10 Tf 1 0 0 1 20 {y} Tm <{'0061006200200063' * 10}> Tj ET" for y in range(700, 20, -14))))
    fast = [list(pdf.read(f)) for f in files]
    assert any(isinstance(g, pdf.Run) for f in files for d in [pdf.Document(f)] for g in pdf.glyphs(d, d.pages[0]))
    monkeypatch.setattr(pdf.Font, "shown", lambda self, raw: None)
    assert fast == [list(pdf.read(f)) for f in files]


def test_objects_are_found_as_by_one_pattern():
    import re

    rng = random.Random(4)
    whole = re.compile(rb"(?<![0-9])(\d{1,10})[\x00\t\n\f\r ]+(\d{1,5})[\x00\t\n\f\r ]+obj\b")
    for _ in range(400):
        data = b"".join(rng.choices([b"1", b"20", b"0 obj", b" obj", b" ", b" " * 90, b"endobj", b"x", b"123456", b"\n", b"obj"], k=30))
        assert list(pdf._objects(data)) == [(int(m[1]), m.end()) for m in whole.finditer(data)]
