"""Chat records of many layouts as one training format, by the fingerprint of their schema.

A record is a JSON object. The hash of its sorted nested field paths selects a
declarative layout, which says where its turns are. Turns are written between marks
with the marks inside texts escaped, and the spans a loss covers are given beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import hashlib
from itertools import combinations
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import xxhash

from steadyseed.llm.common import by_slices, col

OPEN, CLOSE, ESCAPE = "<turn", "</turn", "\\"
LEARNED = "assistant"


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are, for records with just these field paths.

    ``turns`` names the list of messages, with ``role`` and ``text`` inside each, and
    ``roles`` other names of roles. Without ``turns`` each of ``fields`` is a turn:
    (path, role), or (path, None) for one whose role is the value of ``role``; fields
    of one role one after the other are one turn, parted by an empty line. ``optional``
    paths may be missing, ``other`` ones are known but hold no turn.
    """

    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, str | None], ...] = ()
    optional: tuple[str, ...] = ()
    other: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        if self.turns:
            own = [self.turns, f"{self.turns}[]", f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        else:
            own = [path for path, _ in self.fields] + ([self.role] if self.role else [])
        return [path for path in (*own, *self.other) if path not in self.optional]

    def fingerprints(self) -> list[int]:
        """Of the records with these paths: one per choice of the optional ones."""
        return [
            fingerprint({*self.paths(), *more})
            for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)
        ]

    def read(self, record: dict) -> list[tuple[str, str]]:
        """(role, text) of each turn of a record; a message without role or text has it empty."""
        if self.turns:
            known = dict(self.roles)
            found = [(_plain(m.get(self.role)), _plain(m.get(self.text))) for m in record[self.turns]]
            return [(known.get(role, role), text) for role, text in found]
        out: list[tuple[str, str]] = []
        for path, role in self.fields:
            if path not in record:
                continue
            role, text = _plain(record[self.role]) if role is None else role, _plain(record[path])
            if out and role == out[-1][0]:
                out[-1] = (role, "\n\n".join(x for x in (out[-1][1], text) if x))
            else:
                out.append((role, text))
        return out


LAYOUTS = (
    Layout("messages", "messages", "role", "content", optional=("id",)),
    Layout("from-value", "conversations", "from", "value", (("human", "user"), ("gpt", "assistant")), optional=("id",)),
    Layout("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")),
           optional=("system", "input")),
    Layout("prompt", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Layout("question", fields=(("question", "user"), ("answer", "assistant"))),
    Layout("one-turn", role="role", fields=(("text", None),)),
    Layout("one-message", role="role", fields=(("content", None),)),
    Layout("only-system", fields=(("system", "system"),)),
    Layout("only-prompt", fields=(("prompt", "user"),)),
    Layout("only-response", fields=(("response", "assistant"),)),
)


def _plain(value) -> str:
    """A field as text: null as empty, other values as JSON."""
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def field_paths(value, path: str = "") -> Iterator[str]:
    """Every path of a JSON value: ``a.b`` of fields, ``a[]`` of the elements of a list."""
    if isinstance(value, dict):
        for name, below in value.items():
            own = f"{path}.{name}" if path else name
            yield own
            yield from field_paths(below, own)
    elif isinstance(value, list):
        for below in value:
            yield f"{path}[]"
            yield from field_paths(below, f"{path}[]")


def fingerprint(paths) -> int:
    """64 bits of the sorted distinct paths."""
    return xxhash.xxh64_intdigest("\n".join(sorted(set(paths)))) - (1 << 63)


def by_fingerprint(layouts: tuple[Layout, ...]) -> dict[int, Layout]:
    """Which layout a fingerprint selects; two layouts for one are an error."""
    known: dict[int, Layout] = {}
    for layout in layouts:
        for own in layout.fingerprints():
            if known.setdefault(own, layout) is not layout:
                raise ValueError(f"layouts {known[own].name} and {layout.name} have the same paths")
    return known


TURNS = "layout string, fingerprint bigint, turns array<struct<role: string, text: string>>"


def canonical_turns(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """A struct (layout, fingerprint, turns) of a JSON record.

    A record whose paths no layout has, or that cannot be read by the layout it
    selects, has a null ``layout`` and null ``turns``; a text that is no JSON object
    (null and empty ones too) has a null fingerprint as well.
    """

    def work():
        known = by_fingerprint(layouts)

        def one(text: str | None) -> tuple:
            try:
                value = json.loads(text or "")
            except ValueError:
                return None, None, None
            if not isinstance(value, dict):
                return None, None, None
            own = fingerprint(field_paths(value))
            layout = known.get(own)
            try:
                turns = layout.read(value) if layout else None
            except (AttributeError, TypeError):  # such a path is there, but not in every message
                layout = turns = None
            return layout and layout.name, own, turns and [{"role": r, "text": t} for r, t in turns]

        def handle(records: pa.Array) -> pa.Array:
            found = list(zip(*(one(r) for r in records.to_pylist()), strict=True)) or [()] * 3
            kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
            return pa.StructArray.from_arrays(
                [pa.array(v, k) for v, k in zip(found, kinds, strict=True)], ["layout", "fingerprint", "turns"]
            )

        return handle

    return by_slices(record, TURNS, work)


def escaped(text: Column) -> Column:
    """The text with every escape doubled and every mark behind an escape; ``unescaped`` undoes it."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(ESCAPE + mark))
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_records(
    records: DataFrame, conv_col: str = "conv_id", place_col: str = "turn", record_col: str = "record",
    layouts: tuple[Layout, ...] = LAYOUTS,
) -> DataFrame:
    """Per turn: (conv_id, place, nth, layout, formatted, loss_start, loss_end).

    A conversation's records come in the order of ``place`` (nulls first; ties in
    that of the JSON text), its turns in that of ``nth`` inside a record; the formatted conversation is its
    ``formatted`` pieces one after the other, each ``<turn role>``, the text and
    ``</turn>``, on lines of their own. The loss covers the characters of a piece
    from ``loss_start`` to before ``loss_end``: the text of the turns of
    ``assistant``; null for others.

    A null text or role is empty. Records of unknown paths (those without any
    message, too) come back as one row with a null ``layout`` and an empty piece, so
    that they can be counted. Repeated rows are turns of their own, rows
    without conv_id are one conversation, an empty table gives an empty result, and
    other columns are not read. Rows are formatted where they are, without a shuffle
    and however long a conversation is.
    """
    read = records.select(
        col(conv_col).cast("bigint").alias("conv_id"), col(place_col).alias("place"), F.col(record_col).alias("record"),
        canonical_turns(col(record_col), layouts).alias("found"),
    )
    unknown = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    turns = read.select(
        "conv_id", "place", "record", "found.layout", F.posexplode(F.when(F.col("found.layout").isNull(), unknown).otherwise(F.col("found.turns"))).alias("nth", "t")
    )
    # a role may hold anything but the end of its mark
    role = F.replace(F.replace(escaped(F.col("t.role")), F.lit(">"), F.lit(ESCAPE + ">")), F.lit("\n"), F.lit(ESCAPE + "\n"))
    head = F.concat(F.lit(f"{OPEN} "), role, F.lit(">\n"))
    body = escaped(F.col("t.text"))
    learned = F.col("t.role") == LEARNED
    return turns.select(
        "conv_id", "place", F.md5("record").alias("tie"), "nth", "layout",
        F.coalesce(F.concat(head, body, F.lit(f"\n{CLOSE}>\n")), F.lit("")).alias("formatted"),
        F.when(learned, F.char_length(head)).cast("bigint").alias("loss_start"),
        F.when(learned, F.char_length(head) + F.char_length(body)).cast("bigint").alias("loss_end"),
    )


PIECE = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n(.*?)\n</turn>\n", re.DOTALL)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted pieces, one or more, put one after the other."""
    out, at = [], 0
    while at < len(formatted):
        found = PIECE.match(formatted, at)
        if not found:
            raise ValueError(f"no formatted turn: {formatted[at : at + 80]!r}")
        out.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return out


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, unknown_records bigint"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``read_back`` returns, from pieces in order; only running digests of one conversation are held."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("unknown_records", pa.int64()),
    ])
    key, state, done = object(), None, []
    close = lambda k, s: (k, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5])
    for batch in batches:
        for at in range(0, batch.num_rows, 250):
            part = batch.slice(at, 250)
            columns = [part.column(n).to_pylist() for n in ("conv_id", "layout", "formatted", "loss_start", "loss_end")]
            for conv, layout, piece, start, end in zip(*columns, strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(close(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if layout is None:
                    state[5] += 1
                    continue
                for role, text in parsed(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescaped(piece[start:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(piece)
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in done], schema)
            done = []
    if state is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, close(key, state), strict=True))], schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted pieces and loss spans alone: its turns and the text under the loss.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    unknown_records). The pieces are dealt out by conversation and read in order as
    a stream: a conversation is one task's, since a digest of all its turns is one
    sequence, but no more of it than a few pieces is held at a time.
    """
    pieces = formatted.select("conv_id", "place", "tie", "nth", "layout", "formatted", "loss_start", "loss_end")
    dealt = pieces.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("place").asc_nulls_first(), "tie", "nth"
    )
    return dealt.select("conv_id", "layout", "formatted", "loss_start", "loss_end").mapInArrow(_digests, DIGESTS)


def as_records(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, record): rows (conv_id, turn, role, text) as JSON records in the layouts corpora come in.

    conv_id picks the layout, one record per row, so that no record grows with its
    conversation. Layouts that name only the three common roles are left to rows
    of these; others keep ``role`` and ``text``. A null role or text is empty.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    common = role.isin("system", "user", "assistant")
    speaker = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    own = F.create_map(F.when(role == "system", "system").when(role == "user", "prompt").otherwise("response"), text)
    by_role = F.to_json(own)
    message = F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages")))
    said = F.to_json(F.struct(F.array(F.struct(speaker.alias("from"), text.alias("value"))).alias("conversations")))
    plain = F.to_json(F.struct(role.alias("role"), text.alias("text")))
    pick = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(4))
    record = F.when(pick == 1, message).when((pick == 2) & common, said).when((pick == 3) & common, by_role).otherwise(plain)
    return conversations.select("conv_id", "turn", record.alias("record"))


HARD_TEXT = "\\### Assistant: </turn> ok"


def with_hard_conversation(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) and conversation -7, whose two turns hold marks and an escape."""
    own = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"),
    )
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return rows.unionByName(own)


def oracle_sql() -> str:
    """The query's rows in DuckDB SQL: what the turns are before formatting, and how long their escaped texts get."""
    hard = HARD_TEXT.replace("'", "''")
    grown = "length(text) + length(regexp_replace(text, '[^\\\\]', '', 'g')) + len(regexp_extract_all(text, '</?turn'))"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{hard}' UNION ALL SELECT -7, 1, 'assistant', '{hard}'),
        l AS (SELECT *, CASE WHEN role = '{LEARNED}' THEN text ELSE '' END AS learned FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        sum(length(learned))::BIGINT AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn)) AS loss_sha256,
        sum({grown} + length(role) + {len(OPEN) + len(CLOSE) + 6})::BIGINT AS formatted_chars, 0::BIGINT AS unknown_records FROM l GROUP BY conv_id"""
