import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from steadyseed.llm import fill_in_middle as fim
from tests.llm.conftest import ODD


def plain(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(tokens)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def found(docs):
    rows = fim.transform(docs).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    return rows.collect()


MORE = [
    (100 + i, t, "a") for i, t in enumerate([
        "a", "1", "<", "<P", "x<P>y", "<S>", "ab<M>", "<<P", "P>", "é", "éa", "aé", "日本", "a日b", "🤗🤗a", "\n", "a\r\nb", "ab cd", "abc" * 9, "\x00a", "<P" * 40, "word " * 50_000,
    ])
]


def test_odd_rows(documents, none):
    rows = ODD + MORE + [(200 + i, f"Straße {i} déjà-vu x{'y' * (i % 7)}", "b") for i in range(120)]
    got = found(documents(rows))
    want = [(i, *plain(i, t), t or "") for i, t, _ in rows]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=str) == sorted(want, key=str)
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(none).count() == 0


def test_pieces_are_cut_and_permuted():
    whole = [(0, 0, 10)]
    assert fim.split(whole, 4) == [(0, 0, 4), (0, 4, 10)] and fim.split(whole, 0) == fim.split(whole, 10) == whole
    assert fim.split([(0, 0, 3), (1, 5, 9)], 5) == [(0, 0, 3), (1, 5, 7), (1, 7, 9)]
    text = b"prefixmiddlesuffix"
    for form in ("psm", "spm"):
        for cuts in ((6, 12), (0, 0), (0, 18), (18, 18), (5, 5)):
            pieces = fim.arrange([(0, 0, 9), (0, 9, 18)], cuts, form)
            output = fim.spelled(pieces, text)
            assert fim.streamed(pieces, text) == hashlib.sha256(output).hexdigest()
            assert fim.spelled(fim.restored(output, form), output) == text


def test_a_table_and_sql(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = fim.transform(docs).withColumn("restored_sha256", F.sha2(fim.restore(F.col("output"), F.col("form")).cast("binary"), 256))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet'")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert {tuple(r) for r in got.select(columns).collect()} == set(con.execute(fim.oracle_sql()).fetchall())
