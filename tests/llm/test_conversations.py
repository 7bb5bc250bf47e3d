import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from steadyseed.llm import chat_format, conversation_repair as repair

ROWS = "conv_id bigint, turn bigint, role string, text string"
BLANK, END = " \t\n\x0b\x0c\r", ".!?"


def plain_repair(rows):
    """(cost, audit, kept turns) by trying every way to edit, all ways kept that differ in what they end with."""
    seen, ways = set(), {"": (0, "", [])}
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for state, (cost, audit, out) in list(ways.items()):
                to = "a" if state == "u" else "u"
                new = (cost + 2, audit + "I", [*out, (name[to], "")])
                if to not in ways or new < ways[to]:
                    ways[to] = new
        return ways

    for role, text in rows:
        gone, late = not text.strip(BLANK) or (role, text) in seen, text.rstrip(BLANK)[-1:] not in tuple(END)
        seen.add((role, text))
        late = int(late and not gone)
        found = {}
        for state, (cost, audit, out) in inserted(ways).items():
            options = [(state, (cost + 3, audit + "D", out))]
            if not gone:
                if role[:1] in after[state]:
                    options.append((role[:1], (cost + late, audit + "K", [*out, (role, text)])))
                to = "a" if state == "u" else "u"
                options.append((to, (cost + 2 + late, audit + "R", [*out, (name[to], text)])))
            for to, new in options:
                if to not in found or new < found[to]:
                    found[to] = new
        ways = found
    ways = inserted(ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def exhaustive(rows, most=2):
    """The same for short conversations without any dynamic programme."""
    best, seen = None, set()
    faults = []
    for role, text in rows:
        faults.append((not text.strip(BLANK) or (role, text) in seen, text.rstrip(BLANK)[-1:] not in tuple(END)))
        seen.add((role, text))
    gaps = ["I" * n for n in range(most + 1)]
    for edits in itertools.product("DKR", repeat=len(rows)):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            audit = "".join(i + e for i, e in zip(inserts, (*edits, ""), strict=True))
            cost, roles, left = 0, "", iter(zip(rows, faults, strict=True))
            for e in audit:
                given = "a" if roles[-1:] == "u" else "u"
                if e == "I":
                    cost, roles = cost + 2, roles + given
                    continue
                (role, _), (gone, late) = next(left)
                if e == "D":
                    cost += 3
                elif gone:
                    break
                else:
                    cost, roles = cost + late + 2 * (e == "R"), roles + (given if e == "R" else role[:1] or "?")
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def run(rows, with_turns=True):
    edits, seen = [], {}
    found = repair.Repair(lambda *e: edits.append(e), with_turns)
    for role, text in rows:
        seen[role, text] = seen.get((role, text), 0) + 1
        fault = repair.faults(role, text, seen[role, text])
        found.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    cost, digest = found.end()
    return cost, "".join(letter * times for letter, times, _ in edits), [t for _, _, t in edits if t], digest


def spoken(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


ROLES = ["user", "assistant", "system", "user", "assistant", "admin", "", "tool"]


def conversation(rng, n):
    return [(rng.choice(ROLES[: rng.choice((2, 3, 5, 8))]), rng.choice(["a.", "b!", "c", " ", "", "d?\n", f"{rng.random()}.", f"{rng.random()}"])) for _ in range(n)]


def test_the_cheapest_edits_of_short_conversations():
    rng = random.Random(3)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3):
        for _ in range(12 if n < 3 else 6):
            rows = conversation(rng, n)
            assert run(rows)[:2] == exhaustive(rows), rows


def test_long_conversations_against_whole_strings():
    rng = random.Random(4)
    for k in range(400):
        rows = conversation(rng, rng.randrange(60))
        cost, audit, turns, digest = run(rows)
        assert (cost, audit, turns) == plain_repair(rows), rows
        assert digest == spoken(turns) and run(rows, with_turns=False)[::3] == (cost, digest)
    for rows in ([("user", f"{i}.") for i in range(301)], [("assistant", f"{i}") for i in range(300)], [("user", "")] * 300 + [("user", "x.")]):
        assert run(rows)[:3] == plain_repair(rows)


def test_what_is_certain_leaves_at_once():
    """Good turns and runs of deletions hold no more than a few nodes, however many they are."""
    edits = []
    found = repair.Repair(lambda *e: edits.append(e))
    for i in range(20_000):
        found.add(("user", "assistant")[i % 2], f"{i}.", False, False)
    assert sum(times for _, times, _ in edits) > 19_990
    for _ in range(20_000):
        found.add("user", "", True, False)
    held = 0
    for s in found.survivors:
        node = s.node
        while node is not None:
            held, node = held + 1, node.parent
    assert held < 20
    assert found.end()[0] == 60_000


def plain_damage(rows):
    out = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return sorted(out, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2], r[3]))


def plain_report(rows):
    done = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in plain_damage(rows) if r[0] == conv]
        turns = [t for _, t, _, _ in own if t is not None]
        faults, seen = [], set()
        for _, _, role, text in own:
            bare = text.rstrip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in END else "truncated")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, out = plain_repair([r[2:] for r in own])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        done[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, spoken(out))
    return done


def test_report_of_a_table(spark, tables):
    rows = spark.read.parquet(f"{tables}/conversations.parquet")
    plain = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in rows.collect()]
    got = {r[0]: tuple(r)[1:] for r in repair.report(repair.damaged(rows), present_col="present").collect()}
    assert got == plain_report(plain)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tables}/conversations.parquet'")
    assert {r[0]: tuple(r)[1:] for r in con.execute(repair.oracle_sql()).fetchall()} == got


ODD = [
    (1, 0, "user", None), (1, None, "system", "Hello."), (1, None, "system", "Hello."), (1, 7, None, "x."), (1, 7, "user", "x."), (1, 7, "user", "x."),
    (None, 0, "user", "Who?"), (None, None, None, None), (2, 5, "tool", "t"), (3, 0, "user", "long " * 60_000), (4, None, "user", "a."), (4, None, "user", "b."),
    (5, 1, "user", ""), (5, 9, "assistant", " \n"),
] + [(6, i, ("user", "assistant")[i % 2], f"{i}?") for i in range(40)] + [(c, 0, "user", "Hi.") for c in range(100, 140)]


@pytest.fixture
def odd(spark):
    """Nulls everywhere, long texts, ties, repeated rows, conversations that lose all rows, clashing names."""
    return spark.createDataFrame([(*r, "x", False, 0) for r in ODD], f"{ROWS}, nth string, present boolean, __present int")


def test_report_of_odd_rows(spark, odd):
    damage = repair.damaged(odd)
    got = {r[0]: tuple(r)[1:] for r in repair.report(damage, present_col="present").collect()}
    assert got == plain_report(ODD)
    assert any(v == (0,) * 6 + ("", spoken([])) for v in got.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ODD)
    assert {r[0]: tuple(r)[1:] for r in con.execute(repair.oracle_sql()).fetchall()} == got
    none = spark.createDataFrame([], ROWS)
    assert repair.report(repair.damaged(none), present_col="present").count() == repair.repaired(none).count() == 0


def test_repaired_turns(odd):
    got = {}
    for r in sorted(repair.repaired(odd).collect(), key=lambda r: (str(r.conv_id), r.place)):
        got.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    whole = {r.conv_id: r for r in repair.report(odd).collect()}
    for conv, turns in got.items():
        assert spoken([t[1:] for t in turns]) == whole[conv].repaired_sha256
        assert "".join(t[0] for t in turns) == whole[conv].audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(t[1][:1] for t in turns))
    assert {c for c in whole if c not in got} == {c for c, r in whole.items() if set(r.audit) <= {"D"}}


# --- formatting ---------------------------------------------------------------


def plain_chat(rows):
    done = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [(r or "", t or "") for _, _, r, t in own]
        learned = "".join(t for r, t in turns if r == "assistant")
        done[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return done


HARD = [
    (1, 0, "user", None), (1, 1, "assistant", "\\"), (1, 2, "assistant", "\n</turn>\n<turn user>\nno\n</turn>\n"), (2, None, None, ""), (2, 0, "a>\n\\b", "<turn x>"),
    (3, 0, "system", "\\</turn>\\\\<turn"), (3, 1, "user", "日本語 🤗\n\n"), (3, 2, "assistant", "{\"role\": 1}"), (None, 0, "user", "x"), (None, 1, "assistant", "y " * 50_000),
    (6, 0, "user", "u"), (6, 1, "assistant", "w"), (7, 0, "user", "u"), (7, 1, "human", "w"), (7, 2, "assistant", ""),
]


def test_read_back_is_what_was_written(spark):
    rows = spark.createDataFrame([(*r, "x", "y") for r in HARD], f"{ROWS}, record string, formatted string")
    formatted = chat_format.format_records(chat_format.as_records(chat_format.with_hard_conversation(rows)))
    hard = [(-7, 0, "user", chat_format.HARD_TEXT), (-7, 1, "assistant", chat_format.HARD_TEXT)]
    got = {r[0]: tuple(r)[1:5] for r in chat_format.read_back(formatted).collect()}
    assert got == plain_chat(HARD + hard)
    pieces = [r.formatted for r in formatted.where("conv_id = 3").orderBy("place").collect()]
    assert chat_format.parsed("".join(pieces)) == [(r, t) for c, _, r, t in HARD if c == 3]
    assert len({r.layout for r in formatted.collect()}) >= 5
    none = chat_format.read_back(chat_format.format_records(chat_format.as_records(spark.createDataFrame([], ROWS))))
    assert none.count() == 0


def test_a_table_of_conversations_and_sql(spark, tables):
    rows = spark.read.parquet(f"{tables}/conversations.parquet")
    got = chat_format.read_back(chat_format.format_records(chat_format.as_records(chat_format.with_hard_conversation(rows))))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tables}/conversations.parquet'")
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(chat_format.oracle_sql()).fetchall())


RECORDS = {
    '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": null}]}':
        ("messages", [("system", "s"), ("user", "u"), ("assistant", "")]),
    '{"messages": [{"content": "u", "role": "user"}], "id": 5}': ("messages", [("user", "u")]),
    '{"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}': ("from-value", [("user", "u"), ("assistant", "a")]),
    '{"instruction": "do", "input": "", "output": "done"}': ("instruction", [("user", "do"), ("assistant", "done")]),
    '{"instruction": "do", "output": "done", "input": "this", "system": "s"}': ("instruction", [("system", "s"), ("user", "do\n\nthis"), ("assistant", "done")]),
    '{"instruction": "do", "output": 5}': ("instruction", [("user", "do"), ("assistant", "5")]), '{"instruction": "do", "output": ["x", 1]}': (None, None),
    '{"prompt": "p", "response": "r"}': ("prompt", [("user", "p"), ("assistant", "r")]),
    '{"question": "q", "answer": "a"}': ("question", [("user", "q"), ("assistant", "a")]),
    '{"messages": []}': (None, None), '{"messages": ["x"]}': (None, None), '{"strange": 1}': (None, None), "[1]": (None, None), "": (None, None), "no": (None, None), None: (None, None),
    '{"messages": [{"role": "user", "content": "u"}, 5]}': (None, None),
}


def test_fingerprints_select_layouts(spark):
    rows = spark.createDataFrame(list(enumerate(RECORDS)), "conv_id bigint, record string")
    got = {r.record: (r.f.layout, r.f.turns and [tuple(t) for t in r.f.turns]) for r in rows.select("record", chat_format.canonical_turns(rows.record).alias("f")).collect()}
    assert got == RECORDS
    formatted = chat_format.format_records(rows, place_col="conv_id")
    back = {r.conv_id: (r.n_turns, r.unknown_records) for r in chat_format.read_back(formatted).collect()}
    assert back == {i: (len(t or []), int(n is None)) for i, (n, t) in enumerate(RECORDS.values())}


def test_layouts_of_the_same_paths_are_refused():
    with pytest.raises(ValueError):
        chat_format.by_fingerprint((*chat_format.LAYOUTS, chat_format.Layout("again", fields=(("question", "user"), ("answer", "user")))))
