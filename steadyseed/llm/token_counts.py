"""Token counts by finite-state transducers compiled from a byte-pair vocabulary with word ends."""

from __future__ import annotations

from functools import cache
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import regex
from tokenizers import Tokenizer

from steadyseed.llm.common import by_slices, col, text_of

CHUNK_CHARS = 1 << 16
WORDS_KEPT = 120_000
STATES_KEPT = 100_000
# Fixed value: the pre-tokenisation pattern of the vocabulary file this operator understands.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordTransducer:
    """A deterministic transducer that reads a word's bytes and emits its number of tokens.

    A state holds what the rest of the word can depend on: for each boundary from
    which a token may still reach beyond the bytes read, the bytes since then, the
    last token before it and the tokens up to it. Exactly one token ends at each
    byte such that it and the token before it stay apart under the merges; a
    transition carries the change of the count this makes, and a state's end
    carries the tokens that the end of the word adds. States are determinised when
    a text first needs them; when there are too many, the table starts anew, which
    changes no count.
    """

    def __init__(self, vocabulary: list[str], merges: list[tuple[str, str]], end: str):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.end = end
        # a final token is written with the end mark, which is not a letter of a byte
        self.tokens = set(vocabulary)
        self.starts = {t[:n] for t in vocabulary for n in range(1, len(t.removesuffix(end)) + 1)}
        self.apart: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[int, str, str] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        # state and letter as one number: the next state and the change of the count, or the tokens that the end adds
        self.moves: dict[int, tuple[int, int]] = {}
        self.ends: dict[int, int] = {}
        self.initial = self._number((("", "", 0),))

    def _number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
        return n

    def merge(self, symbols: list[str]) -> list[str]:
        """The symbols after the next merge: of the pair of least rank, the leftmost."""
        at = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), len(self.rank)))
        if (symbols[at], symbols[at + 1]) not in self.rank:
            return symbols
        return [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]

    def _symbols(self, token: str) -> list[str]:
        letters = list(token.removesuffix(self.end))
        if token.endswith(self.end) and token != self.end:
            letters[-1] += self.end
        return letters

    def _made(self, token: str) -> tuple[int, str, str] | None:
        """The rank and the parts of the merge that completes the token from its own letters; None if none does.

        A single symbol has rank -1.
        """
        if token not in self.parts:
            symbols = self._symbols(token)
            made = (-1, token, token) if len(symbols) == 1 else None
            while len(symbols) > 1:
                last, symbols = symbols, self.merge(symbols)
                if symbols == last:
                    break
                if len(symbols) == 1:
                    made = (self.rank[last[0], last[1]], last[0], last[1]) if len(last) == 2 else None
            self.parts[token] = made
        return self.parts[token]

    def _stays(self, before: str, token: str) -> bool:
        """Whether the merges leave the two tokens as they are, side by side.

        The two are taken apart again in the reverse order of their merges; they
        do not stay if the symbols that then meet would have merged earlier.
        """
        if self._made(token) is None:
            return False
        if not before:
            return True
        known = self.apart.get((before, token))
        if known is None:
            left, right, until = before, token, len(self.rank)
            while True:
                if self.rank.get((left, right), len(self.rank)) < until:
                    known = False
                    break
                (at_left, _, inner), (at_right, first, _) = self._made(left), self._made(right)
                if at_left < 0 and at_right < 0:
                    known = True
                    break
                if at_left > at_right:
                    until, left = at_left, inner
                else:
                    until, right = at_right + 1, first
            if len(self.apart) > STATES_KEPT:
                self.apart.clear()
            self.apart[before, token] = known
        return known

    def _last(self, state: tuple, letter: str) -> tuple[str, int]:
        """The token that ends with ``letter`` and the tokens up to and with it."""
        for since, before, count in state:
            token = since + letter
            if token in self.tokens and self._stays(before, token):
                return token, count + 1
        raise ValueError(f"the vocabulary has no token for {letter!r}")

    def step(self, number: int, letter: str) -> tuple[int, int]:
        """The next state and the change of the token count."""
        state = self.states[number]
        token, count = self._last(state, letter)
        alive = tuple((since + letter, before, c - count) for since, before, c in state if since + letter in self.starts)
        return self._number((*alive, ("", token, 0))), count

    def count(self, word: str) -> int:
        """Tokens of a word given as byte letters."""
        if len(self.states) > STATES_KEPT:
            self.reset()
        state, total, moves = self.initial, 0, self.moves
        for letter in word[:-1]:
            at = state << 9 | ord(letter)
            move = moves.get(at)
            if move is None:
                move = moves[at] = self.step(state, letter)
            state = move[0]
            total += move[1]
        at = state << 9 | ord(word[-1])
        last = self.ends.get(at)
        if last is None:
            last = self.ends[at] = self._last(self.states[state], word[-1] + self.end)[1]
        return total + last


class Kept(dict):
    """A table of at most twice ``most`` entries: when it is full, what has not been asked for again is forgotten."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class ChunkMap:
    """What a chunk does to the state it is entered in: a monoid.

    White space resets the transducer, so a map is the piece before the chunk's
    first white space (which completes the state it is entered in), the tokens
    between the first and the last, and the piece after the last (the state it is
    left in). A chunk without white space is one open piece.
    """

    __slots__ = ("head", "inner", "tail")

    def __init__(self, head: str, inner: int | None, tail: str):
        self.head, self.inner, self.tail = head, inner, tail


class LibraryClasses:
    """Where the library's Unicode tables and Python's part, found by asking the library.

    They are of several versions: letters and marks that one knows and another does
    not are classed, lowered or ordered otherwise. ``young`` finds a text with any of
    these, which the library's own normaliser then reads, and ``words`` is the word
    pattern with the library's classes.
    """

    def __init__(self, path: str):
        own = Tokenizer.from_file(path)
        self.normalise = own.normalizer.normalize_str
        parts = own.pre_tokenizer.pre_tokenize_str
        known = regex.compile(r"[\p{L}\p{N}]")
        unsure, others = [], []
        for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
            if unicodedata.combining(c):
                marks = f"a{c}\u0316"
                if self.normalise(marks) != normalised(marks):
                    unsure.append(c)
            elif unicodedata.category(c) == "Cn" and known.match(c):
                unsure.append(c)
                if len(parts(f"!{c}!")) == 1:
                    others.append(c)
        self.young = re.compile(f"[{ranges(unsure)}]")
        other = f"[{ranges(others)}]"
        classes = WORD_PATTERN.replace(r"[\p{L}]", rf"[\p{{L}}--{other}]").replace(r"[\p{N}]", rf"[\p{{N}}--{other}]")
        classes = classes.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{other}]")
        self.words = regex.compile(classes.replace(r"\s", r"\p{White_Space}"), regex.V1)


def ranges(letters: list[str]) -> str:
    """Ascending letters as the inside of a character class."""
    runs: list[list[int]] = []
    for c in map(ord, letters):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


def normalised(text: str) -> str:
    """The vocabulary's normaliser but for white space: composed and lowered, letters one by one, without a final sigma."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class TokenCounter:
    """Counts the tokens of texts as the vocabulary's library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        model = spec["model"]
        if kinds != ["NFC", "Replace", "Lowercase"] or splits[0]["pattern"]["Regex"] != WORD_PATTERN or not model["end_of_word_suffix"]:
            raise ValueError("only vocabularies of this normaliser and word pattern can be compiled")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = WordTransducer(list(model["vocab"]), merges, model["end_of_word_suffix"])
        self.letters = byte_letters()
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.words = regex.compile(WORD_PATTERN.replace(r"\s", r"\p{White_Space}"))
        self.library = LibraryClasses(path)
        self.space = regex.compile(r"\p{White_Space}")
        self.odd = re.compile(r"[\x1c-\x1f]")
        self.known = Kept(self.word, WORDS_KEPT)
        self.pieces = Kept(self.between, WORDS_KEPT)

    def word(self, word: str) -> int:
        """Tokens of one word of the pattern."""
        letters = self.letters
        return self.transducer.count("".join([letters[b] for b in word.encode("utf-8", "replace")]))

    def between(self, piece: str) -> int:
        """Tokens of a piece between two resets."""
        words = self.words if piece.isascii() or not self.library.young.search(piece) else self.library.words
        return sum(map(self.known.__getitem__, words.findall(piece)))

    def run(self, text: str) -> int:
        """Tokens of normalised text whose ends are resets."""
        # str.split() would also part at the odd ones, which are no white space here
        pieces = [p for p in self.space.split(text) if p] if self.odd.search(text) else text.split()
        return sum(map(self.pieces.__getitem__, pieces))

    def chunk(self, text: str) -> ChunkMap:
        first = self.space.search(text)
        if first is None:
            return ChunkMap(text, None, "")
        last = next(i for i in range(len(text) - 1, -1, -1) if self.space.match(text, i))
        return ChunkMap(text[: first.start()], self.run(text[first.start() : last]), text[last + 1 :])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.inner is None and b.inner is None:
            return ChunkMap(a.head + b.head, None, "")
        if a.inner is None:
            return ChunkMap(a.head + b.head, b.inner, b.tail)
        if b.inner is None:
            return ChunkMap(a.head, a.inner, a.tail + b.head)
        return ChunkMap(a.head, a.inner + self.run(a.tail + b.head) + b.inner, b.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """The composition of all maps, neighbours first: the up-sweep of a prefix scan."""
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def plain(self, text: str, chunk_chars: int) -> int:
        """Tokens of text without special strings."""
        if text.isascii() or not self.library.young.search(text):
            text = normalised(text)
        else:
            text = self.library.normalise(text)
        if len(text) <= chunk_chars:
            return self.run(text)
        whole = self.scan([self.chunk(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)])
        return self.run(whole.head) + (0 if whole.inner is None else whole.inner + self.run(whole.tail))

    def count(self, text: str | None, chunk_chars: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.plain(text, chunk_chars)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(self.plain(p, chunk_chars) for p in pieces if p)


@cache
def counter(path: str) -> TokenCounter:
    """One compiled counter per Python worker."""
    return TokenCounter(path)


def token_count(text: Column, path: str, chunk_chars: int = CHUNK_CHARS) -> Column:
    def work():
        tokens = counter(path)
        return lambda texts: pa.array([tokens.count(t, chunk_chars) for t in texts.to_pylist()], pa.int64())

    return by_slices(text, "bigint", work)


def count_tokens(
    docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """Per document: (doc_id, n_bytes, n_tokens, over_limit).

    ``path`` names a vocabulary file present on every executor. Strings of special
    tokens inside a text count as one token each, as the library's default has it.

    A null or empty text has 0 bytes and 0 tokens. Texts of any length are read in
    chunks of ``chunk_chars`` whose maps are composed. Rows are counted one by one,
    so repeated rows and null doc_ids come back as they are; an empty table gives
    an empty result; other columns are not read. There is no shuffle.
    """
    text = text_of(text_col)
    counted = docs.select(
        col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), token_count(text, path, chunk_chars).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
