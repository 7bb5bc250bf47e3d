"""Repair of conversation structure by the cheapest edits, found in one pass over each conversation.

The roles of a repaired conversation follow ``(s?(ua)+)?``. A Viterbi pass keeps for
each of the four states of that pattern the cheapest edits so far; of equally cheap
ones those whose initials come first. Survivors hang in a backpointer tree whose nodes
count their references: a branch that no survivor needs goes at once, and as soon as
all survivors share an ancestor the edits up to it are final and leave the tree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from steadyseed.llm.common import col, unused

# What edits cost, white space, ends of sentences, the legal pairs of role initials.
KEEP, TRUNCATED, INSERT, REROLE, DELETE = 0, 1, 2, 2, 3
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
LEGAL = ("su", "ua", "au")

#: States by what was kept last: nothing, the system's turn, a user's, an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Which state a role initial leads to, and the role that an inserted or rerolled turn has.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
GIVEN = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: Turns to insert at the end of the conversation.
MISSING_AT_END = (0, 2, 1, 0)
#: GAP[y][x]: what can be done from state x can be done from y for at most so much more, whatever follows. From nothing
#: a system's turn could still be kept, which others delete; before an assistant's turn a user's has to be inserted.
GAP = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))


class Node:
    """An edit (``times`` alike, for deletions in a row) and how many nodes and survivors hang on it."""

    __slots__ = ("parent", "letter", "times", "turn", "refs", "children")

    def __init__(self, parent: Node | None, letter: str, turn: tuple[str, str] | None):
        self.parent, self.letter, self.turn = parent, letter, turn
        self.times, self.refs, self.children = 1, 0, []
        if parent is not None:
            parent.refs += 1
            parent.children.append(self)


class Survivor:
    """The cheapest edits that end in a state: cost, place among the survivors' edits, last node, digest of what they keep."""

    __slots__ = ("state", "cost", "rank", "node", "digest")

    def __init__(self, state: int, cost: int, rank: int, node: Node, digest):
        self.state, self.cost, self.rank, self.node, self.digest = state, cost, rank, node, digest


class Repair:
    """The pass over one conversation. ``final`` is called with (letter, times, turn) of each edit once it is certain.

    ``turn`` is the (role, text) that an edit leaves, None for a deletion. With
    ``with_turns`` off it is always None, and no text is held until its edit is certain.
    """

    def __init__(self, final: Callable[[str, int, tuple | None], None], with_turns: bool = True):
        self.final, self.with_turns = final, with_turns
        self.root = Node(None, "", None)
        self.root.refs = 1
        self.survivors = [Survivor(NOTHING, 0, 0, self.root, hashlib.sha256())]

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """The next row of the conversation."""
        best: dict[int, tuple] = {}
        late = TRUNCATED if truncated else 0
        for s in self.survivors:
            state, cost, letters, turns = s.state, s.cost, "", []
            for inserts in (0, 1):  # two in a row end where they began, or skip a system's turn: never the cheapest
                if inserts:
                    name, state = GIVEN[state]
                    cost, letters, turns = cost + INSERT, "I", [(name, "")]
                options = [(cost + DELETE, s.rank, letters + "D", state, s, turns)]
                if not must_go:
                    after = FOLLOWS[state].get(role[:1])
                    if after is not None:
                        options.append((cost + KEEP + late, s.rank, letters + "K", after, s, [*turns, (role, text)]))
                    name, after = GIVEN[state]
                    options.append((cost + REROLE + late, s.rank, letters + "R", after, s, [*turns, (name, text)]))
                for option in options:
                    # Of equal cost: the survivors' order is that of their whole unresolved edits, as all have edited the same
                    # rows and none is the beginning of another; edits of one survivor differ in their last letters.
                    if option[3] not in best or option[:3] < best[option[3]][:3]:
                        best[option[3]] = option
        chosen = [o for o in best.values() if not any(x[0] + GAP[x[3]][o[3]] < o[0] for x in best.values())]
        self._replace(sorted(chosen, key=lambda o: o[1:3]))

    def _replace(self, chosen: list[tuple]) -> None:
        """New survivors, in the order of their edits; what none of them needs is freed, what all share is final."""
        uses: dict[int, int] = {}
        for o in chosen:
            uses[id(o[4])] = uses.get(id(o[4]), 0) + 1
        fresh = []
        for place, (cost, _, letters, state, before, turns) in enumerate(chosen):
            node, digest = before.node, before.digest
            if letters == "D" and node.letter == "D" and node.refs == 1 and uses[id(before)] == 1:
                node.times += 1
                node.refs += 1
            else:
                left = iter(turns)
                for letter in letters:
                    node = Node(node, letter, next(left) if self.with_turns and letter != "D" else None)
                node.refs += 1
            if turns:
                digest = digest.copy()
                for i, (role, text) in enumerate(turns):
                    digest.update((f"{role}:{text}" if before.state == NOTHING and i == 0 else f"\n{role}:{text}").encode())
            fresh.append(Survivor(state, cost, place, node, digest))
        for s in self.survivors:
            self._release(s.node)
        self.survivors = fresh
        self._settle()

    @staticmethod
    def _release(node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            parent.refs -= 1
            node.parent, node = None, parent

    def _settle(self) -> None:
        """Edits that all survivors share leave the tree."""
        while self.root.refs == 1 and self.root.children:
            child = self.root.children[0]
            if any(s.node is child for s in self.survivors):
                break  # a survivor's last edit may still be counted up
            self.final(child.letter, child.times, child.turn)
            child.parent, self.root = None, child

    def end(self) -> tuple[int, str]:
        """(cost, SHA-256 in hex of the repaired ``role:text`` lines), after the last edits were final."""
        options = []
        for s in self.survivors:
            state, turns = s.state, []
            for _ in range(MISSING_AT_END[s.state]):
                name, state = GIVEN[state]
                turns.append((name, ""))
            # All have edited the same rows: of survivors' edits none begins another's, so more insertions change no order.
            options.append((s.cost + INSERT * len(turns), s.rank, "I" * len(turns), state, s, turns))
        best = min(options, key=lambda o: o[:2])
        self._replace([best])
        (last,) = self.survivors
        path, node = [], last.node
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.final(node.letter, node.times, node.turn)
        return last.cost, last.digest.hexdigest()


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable, row: Callable, end: Callable) -> Iterator[list]:
    """Runs ``begin(conv_id)``, ``row(state, ..)`` and ``end(state)`` over rows that come conversation by conversation.

    Yields the rows of results (as ``state["out"]`` gathers them) after every few input rows.
    """
    state = None
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            done = []
            for conv, *values in zip(*[c.to_pylist() for c in batch.slice(at, 250).columns], strict=True):
                if state is None or state["conv_id"] != conv:
                    if state is not None:
                        end(state)
                        done += state["out"]
                    state = begin(conv)
                row(state, *values)
            done += state["out"]
            state["out"].clear()
            if done:
                yield done
    if state is not None:
        end(state)
        if state["out"]:
            yield state["out"]


def faults(role: str, text: str, nth: int) -> str | None:
    """A row's first fault."""
    bare = text.rstrip(BLANKS)
    if not bare:
        return "blank"
    if nth > 1:
        return "duplicate"
    return None if bare[-1] in ENDS else "truncated"


REPORT = pa.schema([(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
REPORT_TYPE = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS_TYPE = "conv_id bigint, place bigint, edit string, role string, text string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def begin(conv):
        audit: list[str] = []
        return {
            "conv_id": conv, "out": [], "audit": audit, "repair": Repair(lambda letter, times, _: audit.append(letter * times), False),
            "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": None, "turn": None, "turns": 0, "initial": None,
        }

    def row(state, turn, role, text, nth, present):
        if not present:
            return
        if turn is not None and turn != state["turn"]:
            state["first"] = turn if state["first"] is None else state["first"]
            state["turn"], state["turns"] = turn, state["turns"] + 1
        if state["initial"] is not None and state["initial"] + role[:1] not in LEGAL:
            state["illegal"] += 1
        state["initial"] = role[:1]
        fault = faults(role, text, nth)
        if fault:
            state[fault] += 1
        state["repair"].add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def end(state):
        cost, digest = state["repair"].end()
        gaps = state["turn"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
        state["out"].append((
            state["conv_id"], gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], cost,
            "".join(state["audit"]), digest,
        ))

    for rows in _conversations(batches, begin, row, end):
        yield pa.RecordBatch.from_pylist([dict(zip(REPORT.names, r, strict=True)) for r in rows], REPORT)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def begin(conv):
        state = {"conv_id": conv, "out": [], "place": 0}

        def final(letter, times, turn):
            if turn is not None:
                state["out"].append((conv, state["place"], letter, *turn))
                state["place"] += 1

        state["repair"] = Repair(final)
        return state

    def row(state, turn, role, text, nth, present):
        if present:
            fault = faults(role, text, nth)
            state["repair"].add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    for rows in _conversations(batches, begin, row, lambda state: state["repair"].end()):
        yield pa.RecordBatch.from_pylist([dict(zip(TURNS.names, r, strict=True)) for r in rows], TURNS)


def in_order(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None
) -> DataFrame:
    """(conv_id, turn, role, text, nth, present), each conversation's rows together and in order.

    ``nth`` numbers the rows of one conversation with the same role and text. One
    shuffle, by conversation; both sorts spill.
    """
    name, = unused(rows, "__present")
    plain = rows.withColumn(name, col(present_col) if present_col else F.lit(True)).select(
        col(conv_col).cast("bigint").alias("conv_id"), col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(col(role_col), F.lit(" ")).alias("role"), F.coalesce(col(text_col), F.lit(" ")).alias("text"), F.col(name).alias("present"),
    )
    dealt = plain.repartition("conv_id")
    nulls_first = F.col("turn").asc_nulls_first()
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy(nulls_first)
    numbered = dealt.withColumn("nth", F.row_number().over(same))
    ordered = numbered.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), nulls_first, "role", "text", "nth")
    return ordered.select("conv_id", "turn", "role", "text", "nth", "present")


def report(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None
) -> DataFrame:
    """Per conversation: its faults, what its repair costs, the edits' initials and the digest of the repaired turns.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256); the rules are those of ``Repair`` and ``faults``. Rows whose
    ``present_col`` is false only say that their conversation exists: one with no
    other rows has zeros, an empty audit and the digest of an empty text.

    Rows of a conversation come by turn, null turns first, ties by role and text.
    A null role or text is one space; rows without conv_id are one conversation.
    Repeated rows are duplicates. Empty tables give an empty result, other columns
    are not read. A conversation is streamed through one task, as its digest is one
    sequence; of an undecided stretch the letters are held, and no texts.
    """
    return in_order(rows, conv_col, turn_col, role_col, text_col, present_col).mapInArrow(_report, REPORT_TYPE)


def repaired(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text) per turn that is kept (K), rerolled (R) or inserted (I).

    Edge cases as in ``report``; a conversation of which nothing stays has no row.
    Turns leave as soon as their edit is certain, so the texts held are those of
    the undecided stretch.
    """
    return in_order(rows, conv_col, turn_col, role_col, text_col).mapInArrow(_turns, TURNS_TYPE)


DAMAGES = 20


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with faults put in by the CRC-32 of ``conv_id:turn``, and ``present``.

    Of 20 remainders 0 drops the row (it stays with ``present`` false), 1 empties its
    text, 2 takes out its ``.!?``, 3 repeats it, 4 makes its role user. Nulls are one
    space, in the key too.
    """
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.withColumn("__damage", F.crc32(key.cast("binary")) % DAMAGES)
    damage = F.col("__damage")
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(damage == 4, "user").otherwise(role).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (damage != 0).alias("present"),
        F.explode(F.when(damage == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def oracle_sql() -> str:
    """The query's rows in DuckDB SQL: CRC-32 bit by bit, and the edits with their whole texts, row after row."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: unicode(c)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"

    def then(state: str, cost: str, letters: str, lines: str, sure: str = "true") -> str:
        return f"CASE WHEN {sure} AND {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letters}', 'r': {state}.r || {lines}}} ELSE {none} END"

    def step(to: str) -> str:
        own, user, assistant = "role || ':' || text || chr(10)", "'user:' || text || chr(10)", "'assistant:' || text || chr(10)"
        added = {"user": "'user:' || chr(10)", "assistant": "'assistant:' || chr(10)"}
        ways = [then(to, "3", "D", "''")]
        if to == "s1":
            ways.append(then("s0", "late", "K", own, "NOT gone AND role[1] = 's'"))
        if to == "s2":
            for before in ("s0", "s1", "s3"):
                ways += [then(before, "late", "K", own, "NOT gone AND role[1] = 'u'"), then(before, "2 + late", "R", user, "NOT gone")]
                ways.append(then(before, "5", "ID", added["user"]))
            ways += [then("s2", "2 + late", "IK", f"{added['assistant']} || {own}", "NOT gone AND role[1] = 'u'"),
                     then("s2", "4 + late", "IR", f"{added['assistant']} || {user}", "NOT gone")]
        if to == "s3":
            ways += [then("s2", "late", "K", own, "NOT gone AND role[1] = 'a'"), then("s2", "2 + late", "R", assistant, "NOT gone")]
            ways.append(then("s2", "5", "ID", added["assistant"]))
            for before in ("s0", "s1", "s3"):
                ways += [then(before, "2 + late", "IK", f"{added['user']} || {own}", "NOT gone AND role[1] = 'a'"),
                         then(before, "4 + late", "IR", f"{added['user']} || {assistant}", "NOT gone")]
        return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]

    end = "least(s0, s3, " + then("s1", "4", "II", "'user:' || chr(10) || 'assistant:' || chr(10)") + ", " + then("s2", "2", "I", "'assistant:' || chr(10)") + ")"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        h AS (SELECT *, ({crc}) % {DAMAGES} AS damage FROM k),
        d AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
            CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE damage WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE damage <> 0),
        n AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
        f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
            lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM n),
        e AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS late FROM f),
        v AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM k
            UNION ALL SELECT conv_id, i, z0, z1, z2, z3 FROM (SELECT v.conv_id, e.i, {step('s0')} AS z0, {step('s1')} AS z1, {step('s2')} AS z2, {step('s3')} AS z3
                FROM v JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.i = v.i + 1)),
        b AS (SELECT conv_id, {end} AS best FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id)
    SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(best.r[:-2]) AS repaired_sha256
    FROM b LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM b.conv_id"""
