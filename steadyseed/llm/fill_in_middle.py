"""Fill-in-middle: documents as descriptors over an immutable text and a buffer of sentinels.

A document is a piece table. Its pieces are (buffer, start, end) in bytes: buffer 0
is the text itself, buffer 1 holds the sentinels. Cutting splits the one piece of
the text, an arrangement is a permutation of the three parts, each behind its
sentinel, and the inverse permutation gives the text back. Digests are fed from the
buffers piece by piece, so no arranged text has to exist for them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.llm.common import by_slices, col, text_of

# The sentinels, how many of 100 documents are arranged, how many of those with the suffix first.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ARRANGED, SUFFIX_FIRST = 90, 20

SENTINELS = PREFIX + SUFFIX + MIDDLE
TEXT, MARKS = 0, 1
#: Per form: the sentinels as they come, and which part (0 prefix, 1 middle, 2 suffix) stands before the first, behind the
#: first, and so on; None: nothing.
FORMS = {"psm": ((PREFIX, SUFFIX, MIDDLE), (None, 0, 2, 1)), "spm": ((SUFFIX, PREFIX, MIDDLE), (None, 2, 0, 1))}

LETTER = np.zeros(256, np.bool_)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80

Piece = tuple[int, int, int]


def token_starts(text: np.ndarray) -> np.ndarray:
    """Where the tokens ``[A-Za-z]+|[^A-Za-z]`` of a text in UTF-8 bytes begin, as booleans."""
    letter = LETTER[text]
    starts = ~CONTINUES[text]
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return starts


def code_points(text: np.ndarray) -> int:
    return len(text) - int(CONTINUES[text].sum())


def split(pieces: list[Piece], at: int) -> list[Piece]:
    """The pieces with a cut ``at`` so many bytes from the beginning; at either end nothing changes."""
    out: list[Piece] = []
    for buffer, start, end in pieces:
        if 0 < at < end - start:
            out += [(buffer, start, start + at), (buffer, start + at, end)]
        else:
            out.append((buffer, start, end))
        at -= end - start
    return out


def between(pieces: list[Piece], start: int, end: int) -> list[Piece]:
    """The pieces of the bytes from ``start`` to ``end``."""
    out, at = [], 0
    for piece in split(split(pieces, start), end):
        size = piece[2] - piece[1]
        if size and start <= at and at + size <= end:
            out.append(piece)
        at += size
    return out


def arrange(pieces: list[Piece], cuts: tuple[int, int], form: str) -> list[Piece]:
    """The document cut in three at byte offsets ``cuts`` and laid out as ``form`` says."""
    if form == "plain":
        return pieces
    size = sum(end - start for _, start, end in pieces)
    parts = [between(pieces, 0, cuts[0]), between(pieces, cuts[0], cuts[1]), between(pieces, cuts[1], size)]
    out: list[Piece] = []
    marks, order = FORMS[form]
    for mark, part in zip(marks, order[1:], strict=True):
        at = SENTINELS.index(mark)
        out += [(MARKS, at, at + len(mark)), *parts[part]]
    return out


def restored(output: bytes, form: str) -> list[Piece]:
    """The text as pieces of an arranged output: cut at its sentinels, the parts in their first order."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    marks, order = FORMS[form]
    places, at = [], 0
    for mark in marks:
        at = output.index(mark, at)
        places.append((at, at + len(mark)))
        at += len(mark)
    ends = [start for start, _ in places[1:]] + [len(output)]
    parts = {part: (TEXT, begin, end) for part, (_, begin), end in zip(order[1:], places, ends, strict=True)}
    return [parts[i] for i in range(3)]


def streamed(pieces: list[Piece], text) -> str:
    """SHA-256 in hex of what the pieces spell, buffer by buffer."""
    digest, buffers = hashlib.sha256(), (memoryview(text), memoryview(SENTINELS))
    for buffer, start, end in pieces:
        digest.update(buffers[buffer][start:end])
    return digest.hexdigest()


def spelled(pieces: list[Piece], text) -> bytes:
    buffers = (memoryview(text), memoryview(SENTINELS))
    return b"".join(buffers[buffer][start:end] for buffer, start, end in pieces)


def draws(id_col: Column) -> Column:
    """Four unsigned 32-bit numbers from the SHA-256 of ``1:`` and the decimal doc_id (null: nothing)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])


def cut_document(text: np.ndarray, h: list[int], has_sentinel: bool) -> tuple:
    """(tokens, form, byte offsets of the two cuts) of one text."""
    starts = token_starts(text)
    n = int(starts.sum())
    if not len(text) or has_sentinel or h[2] % 100 >= ARRANGED:
        return n, "plain", (0, 0)
    places = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    at = np.append(np.flatnonzero(starts), len(text))
    return n, "spm" if h[3] % 100 < SUFFIX_FIRST else "psm", (int(at[places[0]]), int(at[places[1]]))


PIECES = "array<struct<buffer: int, start: bigint, end: bigint>>"
ARRANGEMENT = f"n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces {PIECES}, output_sha256 string"


def _bytes_of(texts: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each text, as views of the Arrow buffer; null as empty."""
    binary = texts.cast(pa.large_binary())
    return [memoryview(b.as_buffer()) if b.is_valid else memoryview(b"") for b in binary]


def arrangement(text: Column, h: Column) -> Column:
    """A struct of how a text is cut and laid out, with its pieces (byte offsets) and the digest of the output."""

    def handle(rows: pa.Array) -> pa.Array:
        texts, numbers = rows.field(0), rows.field(1).to_pylist()
        out = []
        for view, own in zip(_bytes_of(texts), numbers, strict=True):
            letters = np.frombuffer(view, np.uint8)
            raw = bytes(view)
            n, form, cuts = cut_document(letters, own, any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)))
            pieces = arrange([(TEXT, 0, len(letters))], cuts, form)
            chars = (None, None) if form == "plain" else (code_points(letters[: cuts[0]]), code_points(letters[cuts[0] : cuts[1]]))
            out.append((n, form, *chars, [dict(zip(("buffer", "start", "end"), p, strict=True)) for p in pieces], streamed(pieces, view)))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        names = ["n", "form", "prefix_chars", "middle_chars", "pieces", "output_sha256"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return by_slices(F.struct(text.alias("text"), h.alias("h")), ARRANGEMENT, lambda: handle)


def written(text: Column, pieces: Column) -> Column:
    """The text that the pieces spell."""

    def handle(rows: pa.Array) -> pa.Array:
        texts = _bytes_of(rows.field(0))
        found = rows.field(1).to_pylist()
        return pa.array([spelled([(p["buffer"], p["start"], p["end"]) for p in own], t).decode() for t, own in zip(texts, found, strict=True)], pa.string())

    return by_slices(F.struct(text.alias("text"), pieces.alias("pieces")), "string", lambda: handle)


def restore(output: Column, form: Column) -> Column:
    """The text from an arranged output and its form alone."""

    def handle(rows: pa.Array) -> pa.Array:
        forms = rows.field(1).to_pylist()
        return pa.array([spelled(restored(bytes(o), f), o).decode() for o, f in zip(_bytes_of(rows.field(0)), forms, strict=True)], pa.string())

    return by_slices(F.struct(output.alias("output"), form.alias("form")), "string", lambda: handle)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (doc_id, n, form, prefix_chars, middle_chars, pieces, output, output_sha256).

    ``n`` counts the tokens ``[A-Za-z]+|[^A-Za-z]``; ``pieces`` are the output's
    (buffer, start, end) in bytes, buffer 0 the text and 1 ``SENTINELS``; the output
    digest is fed from them. The cuts, whether a text is arranged and how, hang on
    doc_id alone.

    A null text is an empty text, and an empty text is plain, with no token. A text
    with a sentinel in it is plain. A null doc_id draws as an id without digits.
    Repeated rows and rows that share a doc_id are each arranged by themselves. An
    empty table gives an empty result; other columns are not read. There is no
    shuffle, and a worker holds a few texts at a time, whatever their length.
    """
    text = text_of(text_col)
    cut = docs.select(col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), arrangement(text, draws(col(id_col))).alias("a"))
    return cut.select(
        "doc_id", "a.n", "a.form", "a.prefix_chars", "a.middle_chars", "a.pieces",
        written(F.col("text"), F.col("a.pieces")).alias("output"), "a.output_sha256",
    )


def oracle_sql() -> str:
    """The query's rows in DuckDB SQL: lists of tokens instead of pieces."""
    h = ", ".join(f"('0x' || sha[{1 + 8 * i}:{8 + 8 * i}])::BIGINT AS h{i + 1}" for i in range(4))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS sha FROM documents),
        t AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens, {h} FROM d),
        c AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
            greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {ARRANGED} THEN 'plain'
                WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM t),
        p AS (SELECT *, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid,
            array_to_string(tokens[b + 1:n], '') AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256 FROM p"""
