import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare
import corpus_pipeline
from steadyseed.llm import quality, sentence_pieces
from steadyseed.llm.common import read
from tests.llm.test_copies import normal, plain_components, plain_print
from tests.llm.test_mixing import plain_mix

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op9_mixing", "op10_exact_dedup"])
def test_queries_match_their_sql(spark, tables, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    df = entry.queries()[name](spark, tables)
    result = con.execute(entry.oracle_sql()[name])
    described = {c[0]: str(c[1]) for c in result.description}
    truth = [dict(zip(described, r, strict=True)) for r in result.fetchall()]
    assert compare([r.asDict() for r in df.collect()], dict(df.dtypes), truth, described) is None


def test_every_operator_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_the_pipeline_against_brute_force(spark):
    docs = read(spark, SMALL, "documents")
    model = quality.fit(docs, read(spark, SMALL, "labels"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect()]
    if model is not None:
        rows = [r for r in rows if model.score(quality.np.array([quality.statistics(r[1])]))[0] >= 0.3]
    first = {}
    for r in rows:
        first.setdefault(normal(r[1]), r)
    rows = list(first.values())
    ids = plain_components([(i, plain_print(t)) for i, t, _ in rows], lambda a, b: bin(a ^ b).count("1") <= 4)
    rows = [r for r, c in zip(rows, ids, strict=True) if r[0] == c]
    want = sorted(int(i) for i, *_, copies in plain_mix(rows) for _ in range(copies))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == want
    codec = sentence_pieces.codec(corpus_pipeline.public_tokenizers.path(corpus_pipeline.PIECE_MODEL))
    texts = {i: t or "" for i, t, _ in rows}
    assert all(codec.decode(sentence_pieces.np.array(r.ids, dtype="int32")) == texts[r.doc_id] and r.parity for r in got)


def test_stages_keep_the_columns_and_survive_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs_out = stage(spark, docs, SMALL)
            assert name == "sentence_pieces" or docs_out.columns == docs.columns
            assert docs_out.count() <= 3 * docs.count()
