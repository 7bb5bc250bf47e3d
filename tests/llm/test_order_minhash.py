from collections import Counter
import hashlib
import random
import re
import string

import pytest

from steadyseed.llm import order_minhash
from tests.llm.conftest import ODD


def plain_rows(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0))
    ordered = sorted(rows, key=key)
    for k, (i, t, _) in enumerate(ordered):
        t, follower = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        yield i, t, t[: len(t) - half] + follower[:half]


@pytest.mark.parametrize("per_range", [2, 2000])
def test_followers_over_ranges(documents, monkeypatch, per_range):
    monkeypatch.setattr(order_minhash, "ROWS_PER_RANGE", per_range)
    rows = [(i * i % 101 - 50, f"text {i} é🤗 " * (i % 9), "s") for i in range(51)]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in order_minhash.compare_documents(documents(rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    for i, t, edited in plain_rows(rows):
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_signature_against_counting(spark):
    """Components are chosen and ordered as a dictionary of occurrence-numbered k-mers gives them."""
    texts = ["a b c d e f a b c d e f a b c", "one", "x y", "w " * 300, "supercalifragilistic word and 日本語テキストの長い文字列 more", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", order_minhash.kmers(order_minhash.F.col("text")).alias("k"), order_minhash.numbered_keys(order_minhash.kmers(order_minhash.F.col("text"))).alias("n"),
        order_minhash.signature(order_minhash.F.col("text")).alias("s"),
    ).where("text <> ''").collect()
    for r in rows:
        units = re.findall(r"[^\x20\x09-\x0D]{1,8}", r.text)
        assert len(r.k) == len(r.n) == max(len(units) - 2, 1)
        grams = [tuple(units[i : i + 3]) for i in range(max(len(units) - 2, 1))]
        assert len(set(r.k)) == len(set(grams))
        assert len({x >> 27 for x in r.n}) == len(r.n)  # repeated k-mers differ by their number
        assert sorted(x & (1 << 27) - 1 for x in r.n) == list(range(len(grams)))
        bins = Counter(x >> 57 for x in r.n)
        assert [x >> 32 for x in r.s] == sorted(bins)


def test_order_and_edits_are_felt(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {"same": words, "one": words[:200] + ["new"] + words[201:], "swapped": words[200:] + words[:200], "back": words[::-1], "other": [f"v{i}" for i in range(400)]}
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "name string, text string")
    s = {r.name: r.s for r in table.select("name", order_minhash.signature(order_minhash.F.col("text")).alias("s")).collect()}
    near = lambda a, b: len(set(s[a]) & set(s[b])) / 64
    assert near("same", "one") > 0.8
    assert near("same", "swapped") < near("same", "one")
    assert near("same", "other") == near("same", "back") == 0


def test_edits_of_long_unspaced_texts(spark):
    """A letter more or less at the start of a run without white space changes little, in any script."""
    draw = random.Random(7)
    alphabets = {"cjk": [chr(0x4E00 + i) for i in range(3000)], "base64": string.ascii_letters + string.digits + "+/", "emoji": [chr(0x1F600 + i) for i in range(60)], "bits": "01"}
    rows = []
    for name, letters in alphabets.items():
        run = "".join(draw.choices(letters, k=5000))
        rows += [(name, k, run, t) for k, t in {
            "same": run, "insert": letters[3 % len(letters)] + run, "delete": run[1:], "between": "word " + run[:2500] + letters[0] + run[2500:], "other": "".join(draw.choices(letters, k=5000)),
        }.items()]
    sign = lambda c: order_minhash.signature(order_minhash.F.col(c))
    table = spark.createDataFrame(rows, "name string, edit string, a string, b string").withColumns({"a": sign("a"), "b": sign("b")})
    near = {(r.name, r.edit): r.near for r in table.select("name", "edit", order_minhash.likeness(order_minhash.F.col("a"), order_minhash.F.col("b")).alias("near")).collect()}
    for name in alphabets:
        assert near[name, "same"] == 1
        assert min(near[name, k] for k in ("insert", "delete", "between")) > 0.85, near
        assert near[name, "other"] < 0.2
    odd = ["=" * 200, "ab" * 500, "x" * 24, "x" * 25]
    found = spark.createDataFrame([(t,) for t in odd], "text string").select(order_minhash.F.size(order_minhash.kmers(order_minhash.F.col("text"))).alias("n")).collect()
    assert all(r.n >= 1 for r in found)


def test_order_is_felt_in_short_texts(spark):
    """Halves swapped: as far apart as with a hash of its own for each component, about a half or less."""
    rows = []
    for n in (30, 60, 90, 130, 150):
        for k in range(20):
            words = [f"w{k}x{n}y{i}" for i in range(n)]
            rows.append((n, " ".join(words), " ".join(words[n // 2 :] + words[: n // 2]), " ".join(words[: n // 2] + ["new"] + words[n // 2 + 1 :])))
    sign = lambda c: order_minhash.signature(order_minhash.F.col(c))
    table = spark.createDataFrame(rows, "n int, a string, swapped string, one string").withColumns({c: sign(c) for c in ("a", "swapped", "one")})
    near = lambda c: order_minhash.F.avg(order_minhash.likeness(order_minhash.F.col("a"), order_minhash.F.col(c))).alias(c)
    for r in table.groupBy("n").agg(near("swapped"), near("one")).collect():
        assert 0.2 < r.swapped < 0.6 and r.swapped < r.one, r


def test_odd_rows(odd, none, documents):
    got = order_minhash.compare_documents(odd).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id in (3, 4)}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (1, 2)} == {""}
    alone = order_minhash.compare_documents(documents([(1, "a b c d", "s")])).collect()
    assert [(r.near_next, r.edited_sha256) for r in alone] == [(1.0, hashlib.sha256(b"a b a b").hexdigest())]
    assert order_minhash.compare_documents(none).count() == 0
