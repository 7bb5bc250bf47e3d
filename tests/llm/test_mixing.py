import hashlib
import re

from steadyseed.llm import mixing
from tests.llm.conftest import ODD


def plain_mix(rows, weights=(5, 2, 1), most=3):
    """Targets by water filling, then whole copies and the documents of smallest place up to the budget."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    capped = set()
    while True:
        num, den = sum(total.values()) - sum(most * total[s] for s in capped), sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and weight[s] * num > most * total[s] * den}
        if not more:
            break
        capped |= more
    target = {s: float(most * total[s]) if s in capped else weight[s] * num / den for s in sources}
    copies = [0] * len(rows)
    equal, place = {}, []
    for i, t, s in rows:
        nth = equal[i, t or "", s] = equal.get((i, t or "", s), -1) + 1
        key = f"mix:{'null' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}:{nth}"
        place.append(int(hashlib.md5(key.encode()).hexdigest()[:15], 16))
    for s in sources:
        own = [k for k, r in enumerate(rows) if r[2] == s]
        times = min(int(target[s] // total[s]), most) if total[s] else 1
        left = target[s] - times * total[s] if total[s] else 0
        for k in own:
            copies[k] = times
        for p in sorted({place[k] for k in own}):
            words = sum(size[k] for k in own if place[k] == p)
            if left <= 0 or 2 * left < words:
                break
            for k in own:
                copies[k] += place[k] == p
            left -= words
    return [(str(i), n, total[s], round(target[s], 6), n * c, c) for (i, _, s), n, c in zip(rows, size, copies, strict=True)]


def test_odd_rows(odd, none):
    got = [(str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken, r.copies) for r in mixing.decide(odd).collect()]
    assert sorted(got) == sorted(plain_mix(ODD))
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    want = sorted((i, s) for (i, *_, c), (_, _, s) in zip(plain_mix(ODD), ODD, strict=True) for _ in range(c) for s in [str(s)])
    assert sorted((str(r.doc_id), str(r.source)) for r in mixed.collect()) == want
    assert mixing.decide(none).count() == mixing.mix(none).count() == 0


def test_a_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixing.decide(docs).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken, r.copies) for r in got) == sorted(plain_mix(rows))
    assert all(r.taken <= 3 * r.size for r in got)
    again = mixing.decide(docs.repartition(7)).collect()
    assert sorted(again, key=str) == sorted(got, key=str)


def test_many_documents_are_refined_to_the_last(spark, documents):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 7 == 0]) for i in range(4000)]
    got = mixing.decide(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((i, n) for i, _, _, _, n, _ in plain_mix(rows))


def test_targets_are_met_with_repeated_and_null_ids(documents):
    """A source whose rows share one doc_id, or have none, or are all equal, is cut like any other."""
    big = [(1000 + i, "w " * 50, "a") for i in range(20)]
    for rows in (
        [(7, f"{i} " + "w " * 9, "b") for i in range(50)], [(None, f"{i} " + "w " * 9, "b") for i in range(50)], [(7, "w " * 10, "b")] * 50, [(None, "w " * 10, None)] * 55,
    ):
        docs = documents(rows + big)
        got = mixing.decide(docs, weights=(8, 3)).collect()
        assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken, r.copies) for r in got) == sorted(plain_mix(rows + big, (8, 3)))
        for source_size in {r.source_size for r in got}:
            own = [r for r in got if r.source_size == source_size]
            assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert mixing.mix(docs, weights=(8, 3)).count() == sum(r.copies for r in got)
