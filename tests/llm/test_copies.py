import hashlib
import random
import re

from pyspark.sql import functions as F
import xxhash

from steadyseed.llm import exact_dedup, simhash_dedup
from steadyseed.llm.components import components
from tests.llm.conftest import ODD


def plain_print(text, size=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items, near):
    """The smallest id reachable, by comparing all pairs."""
    label = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if near(items[i][1], items[j][1]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = {}
    for (i, _), g in zip(items, label, strict=True):
        if i is not None:
            ids[g] = min(ids.get(g, i), i)
    return [ids.get(g) for g in label]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    nodes = sorted({n for u, v in links if u != v for n in (u, v)})
    pairs = {frozenset(x) for x in links}
    want = plain_components([(n, n) for n in nodes], lambda a, b: frozenset((a, b)) in pairs)
    assert got == dict(zip(nodes, want, strict=True))
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_fingerprints_and_links_on_a_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in simhash_dedup.link(docs).collect()}
    prints = [(i, plain_print(t)) for i, t in rows]
    assert all(got[i].fp % (1 << 64) == p for i, p in prints)
    want = plain_components(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert [got[i].component_id for i, _ in prints] == want


def test_every_pair_of_few_bits_is_linked(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for bits in (1, 2, 3, 4, 5, 6):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), bits)))
    centre = rng.getrandbits(64)  # a dense group
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    near = components(simhash_dedup.near_copies(table))
    parts = table.join(near.withColumnRenamed("node", "fp"), "fp", "left").selectExpr("fp", "coalesce(component, fp) AS part")
    far = components(simhash_dedup.far_links(parts))
    final = parts.join(far.withColumnRenamed("node", "part"), "part", "left").selectExpr("fp", "coalesce(component, part) AS part")
    got = {r.fp: r.part for r in final.collect()}
    want = plain_components([(p, p) for p in signed], lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= 4)
    assert [got[p] for p in signed] == want


def test_random_fingerprints_rarely_meet(spark):
    """Both coverings tell 15 of 16 values of four bits apart: far fewer chance meetings than one covering's share of 9e-5."""
    n = 60_000
    cells = simhash_dedup.visits(spark.range(n).select(F.xxhash64("id").alias("fp"))).groupBy("half", "cell").count()
    met = cells.agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    assert cells.agg(F.sum("count")).first()[0] == 66 * n
    assert met < 4e-6 * n * n / 2


def test_large_groups_are_spread(spark, documents, monkeypatch):
    """Groups, parts and fingerprints above the limits go through salts with the same result."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    texts = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(0, 300, 7)] + [" ".join(base)] * 40 + ["", None, "alone here"]
    rows = [(None if i % 11 == 0 else 500 - i, t, "s") for i, t in enumerate(texts)]
    want = sorted((str(r.doc_id), r.fp, r.group, str(r.component_id)) for r in simhash_dedup.link(documents(rows)).collect())
    monkeypatch.setattr(simhash_dedup, "HOT_PRINTS", 2)
    monkeypatch.setattr(simhash_dedup, "HOT_ROWS", 2)
    got = sorted((str(r.doc_id), r.fp, r.group, str(r.component_id)) for r in simhash_dedup.link(documents(rows)).collect())
    assert got == want and len(got) == len(rows)
    prints = [(i, plain_print(t)) for i, t, _ in rows]
    plain = plain_components(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert sorted((str(i), str(c)) for (i, _), c in zip(prints, plain, strict=True)) == [(i, c) for i, _, _, c in want]


def test_odd_rows_are_linked(odd, none):
    got = simhash_dedup.link(odd).collect()
    items = [(i, plain_print(t)) for i, t, _ in ODD]
    want = plain_components(items, lambda a, b: bin(a ^ b).count("1") <= 4)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == sorted(
        (str(i), p, str(c)) for (i, p), c in zip(items, want, strict=True)
    )
    kept = simhash_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(c) for c in set(want))
    assert simhash_dedup.link(none).count() == simhash_dedup.deduplicate(none).count() == 0


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_copies_of_odd_rows(spark, odd, none):
    got = exact_dedup.add_batch(odd, exact_dedup.new_index(spark)).collect()
    groups = {}
    for i, t, _ in ODD:
        groups.setdefault(normal(t), []).append(i)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(str(i), str(first[normal(t)]), len(groups[normal(t)]), i == first[normal(t)], hashlib.sha256(normal(t).encode()).digest()) for i, t, _ in ODD]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, bytes(r.digest)) for r in got) == sorted(want)
    kept = exact_dedup.deduplicate(odd, exact_dedup.new_index(spark))
    assert kept.columns == odd.columns
    assert sorted((str(r.doc_id), normal(r.text)) for r in kept.collect()) == sorted((str(i), t) for t, i in first.items())
    assert exact_dedup.deduplicate(none, exact_dedup.new_index(spark)).count() == 0


def test_the_index_outlasts_its_session_name(spark, documents):
    index = exact_dedup.new_index(spark)
    first = documents([(5, "a", "s"), (6, "b", "s")])
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(first, index).collect()) == [5, 6]
    index.close()
    again = exact_dedup.DigestIndex(spark, index.path)
    second = exact_dedup.add_batch(documents([(1, "b", "s"), (2, "c", "s"), (3, "c ", "s"), (4, "c", "s")]), again).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in second) == [(1, 6, False), (2, 2, True), (3, 3, True), (4, 2, False)]
    assert sorted(r.keep_id for r in again.rows().collect()) == [2, 3, 5, 6]


def test_ranges_meet_the_index_of_earlier_ranges(spark, documents, odd, none):
    rng = random.Random(9)
    rows = [(rng.choice([None, rng.randrange(40)]), rng.choice("abcdefghij") + " " * rng.randrange(3), "s") for _ in range(120)]
    docs = documents(rows)
    index = exact_dedup.new_index(spark)
    got = exact_dedup.add_batches(docs, index, 4).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    by_digest = {hashlib.sha256(t.encode()).digest(): t for t in groups}
    assert len(got) == len(rows)
    for r in got:
        text = by_digest[bytes(r.digest)]
        assert (r.keep_id, r.group_size, r.kept) == (first[text], len(groups[text]), r.doc_id == first[text])
    assert {bytes(r.digest) for r in index.rows().collect()} == set(by_digest)
    assert exact_dedup.add_batches(none, index).count() == 0
    plain = {(r.doc_id, r.mark): r for r in exact_dedup.add_batch(odd, exact_dedup.new_index(spark)).collect()}
    for r in exact_dedup.add_batches(odd, exact_dedup.new_index(spark), 5).collect():
        assert r == plain[r.doc_id, r.mark]
    for n in (1, 2):
        assert sorted(r.doc_id for r in exact_dedup.deduplicate(documents([(5, "a ", "s"), (5, "b", "s"), (5, "a  ", "s")]), exact_dedup.new_index(spark), n).collect()) == [5, 5]


def test_the_visits_of_few_fingerprints_are_not_broadcast(spark):
    rows = [(i, i) for i in range(1, 40)]
    links = simhash_dedup.far_links(spark.createDataFrame(rows, "fp bigint, part bigint"))
    got = {(r.u, r.v) for r in links.collect()}
    assert got == {(a, b) for a, _ in rows for b, _ in rows if a < b and (a ^ b).bit_count() <= 4}
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
