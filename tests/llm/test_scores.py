import zlib

import numpy as np
import pytest

from steadyseed.llm import quality, toxicity
from steadyseed.llm.common import read

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_rows(odd, none, labels, no_labels, operator):
    modulus, rest = operator.MODULUS, operator.HELD_REMAINDER
    for known in (labels, no_labels):
        got = operator.score_documents(odd, known).collect()
        assert len(got) == odd.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % modulus == rest) for r in got)
        assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert operator.score_documents(none, labels).count() == 0


def test_quality_held_out(spark):
    docs, labels = read(spark, LARGER, "documents"), read(spark, LARGER, "labels")
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.97
    assert np.mean([r.predicted for r in got if r.quality == 1]) >= 0.98
    assert set(quality.keep_good(docs, labels).columns) == set(docs.columns)


def test_densities_are_gaussian():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (200, 3)), rng.normal(2, 0.5, (100, 3))])
    y = np.repeat([0, 1], [200, 100])
    model = quality.Discriminant.fit(x, y, own=1.0, ridge=0.0)
    logs = []
    for k in (0, 1):
        m, c = x[y == k].mean(axis=0), np.cov(x[y == k], rowvar=False)
        d = x - m
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))), atol=1e-6)
    assert quality.Discriminant.fit(x, np.zeros(300)) is None


def test_statistics_are_finite():
    for text in (None, "", " ", "x", "\n\n", "1" * 100_000, "🤗 " * 50, "\ud800"):
        assert np.isfinite(quality.statistics(text)).all()


def test_toxicity_held_out(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted for r in got if r.toxic == 1]) >= 0.9
    assert np.mean([r.predicted for r in got if r.toxic == 0]) <= 0.02


def test_clauses_are_weighed_by_the_grammar():
    grammar = toxicity.Grammar({"zorp": 2.0}, {"blargh": 1.0})
    plain = grammar.clause("a zorp here")
    assert grammar.clause("you zorp") == 1.5 * plain
    assert grammar.clause("not a zorp") == pytest.approx(0.4 * plain)
    assert grammar.clause("he said zorp") < grammar.clause("he is zorp")
    assert grammar.clause("zorp zorp") == 1.5 * plain
    assert grammar.clause("blarghish") == 1.0
    assert grammar.clause("kill you") < grammar.clause("i will kill you") or grammar.clause("you i kill") > grammar.clause("i kill")
    assert grammar.clause("nothing at all") == 0
    assert grammar.features("not that. zorp") == grammar.features("zorp. not that")


def test_composition_is_the_product():
    moves, factors = toxicity.compose(toxicity.insult_machine(), toxicity.negation_machine())
    one, two = toxicity.insult_machine(), toxicity.negation_machine()
    state, a, b, total, apart = 0, 0, 0, [], []
    for kind in (0, 4, 1, 1, 0, 0, 1, 4, 4, 1):
        total.append(factors[state][kind])
        state = moves[state][kind]
        (a, f), (b, g) = one.step(a, kind), two.step(b, kind)
        apart.append(f * g)
    assert total == apart
