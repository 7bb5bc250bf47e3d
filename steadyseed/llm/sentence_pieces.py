"""SentencePiece models run by the tokenizers library: encoding, decoding and their parity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.llm.common import by_slices, col, text_of

THREADS = 2
BATCH_CHARS = 1 << 20
WORDS_KEPT = 150_000
BLOCK_WORDS, BLOCKS_AT_ONCE = 512, 64
MARK = "▁"
# Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM_MODEL, BPE_MODEL = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protobuf message: number and value (int, float or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]
        elif kind == 5:
            at += 4
            yield key >> 3, struct.unpack("<f", data[at - 4 : at])[0]
        elif kind == 1:
            at += 8
            yield key >> 3, data[at - 8 : at]
        else:
            raise ValueError(f"wire type {kind}")


@dataclass
class Model:
    """What a model file says: pieces in id order, the kind of model, the normaliser's settings."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM_MODEL
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        model = cls()
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                model.pieces.append((own[1].decode("utf-8"), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                model.kind, model.byte_fallback = own.get(3, UNIGRAM_MODEL), bool(own.get(35, 0))
            elif number == 3:
                own = dict(fields(value))
                model.charsmap, model.dummy_prefix, model.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        model.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        return model

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first, for models that merge by score."""
        score = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
        pairs = [
            (-score[p], ids, left, right)
            for ids, p in enumerate(score)
            for left, right in ((p[:i], p[i:]) for i in range(1, len(p)))
            if left in score and right in score
        ]
        return [(left, right) for _, _, left, right in sorted(pairs, key=lambda x: x[:2])]

    def words_stand_alone(self) -> bool:
        """Whether no piece has the space mark after another letter, so that text may be cut before each run of marks."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def build(model: Model):
    """The model as a tokenizer of the tokenizers library."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    if any(kind == USER_DEFINED for _, _, kind in model.pieces):
        raise ValueError("models with user-defined symbols are not supported")
    if model.kind == BPE_MODEL:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(
            vocab=vocab, merges=model.merges(), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback
        )
    elif model.kind == UNIGRAM_MODEL:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind} is not supported")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if model.words_stand_alone():
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    tokenizer.decoder = decoder(model.dummy_prefix)
    return tokenizer


def decoder(strip: bool):
    """Marks to spaces, bytes to letters, and without the first space where the normaliser put one."""
    from tokenizers import decoders

    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    return decoders.Sequence(undo + ([decoders.Strip(" ", 1, 0)] if strip else []))


class Codec:
    """Encodes and decodes batches with the rebuilt tokenizer, and compares it with the original library.

    Where no piece crosses the start of a word, words are encoded once and kept in
    a bounded table: new words of a batch go to the library together, in threads,
    and each is compared with the original library when it enters the table.
    """

    def __init__(self, path: str, threads: int = THREADS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as file:
            self.model = Model.parse(file.read())
        self.tokenizer = build(self.model)
        self.normalizer, self.decoder = self.tokenizer.normalizer, self.tokenizer.decoder
        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        self.by_word = self.model.words_stand_alone() and self.model.dummy_prefix
        if self.by_word:  # words are normalised already
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = None, None
        self.words: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.older: dict[str, bytes] = {}
        self.differing: set[str] = set()
        self.word = re.compile(f"{MARK}+[^{MARK}]*")
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        loose = decoder(False)
        strings = [
            bytes([int(p[3:-1], 16)]) if kind == BYTE else loose.decode([p]).encode()
            for i, (p, _, kind) in enumerate(self.model.pieces)
        ]
        self.letters = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.sizes = np.array([len(x) for x in strings])
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.plain = not self.model.charsmap and not self.model.squeeze

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids per text, and whether the original library has the same."""
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return [np.array(i, dtype=np.int32) for i in ids], self.agrees(texts, ids)
        split = [self.split(t) for t in texts]
        if len(self.words) > WORDS_KEPT:  # words not met again until the table is full once more are forgotten
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        met = set().union(*split).difference(known)
        known.update((w, older[w]) for w in met if w in older)
        new = [w for w in met if w not in known]
        for at in range(0, len(new), BLOCKS_AT_ONCE * BLOCK_WORDS):
            self.learn(new[at : at + BLOCKS_AT_ONCE * BLOCK_WORDS])
        ids = [np.frombuffer(b"".join(map(known.__getitem__, words)), dtype=np.int32) for words in split]
        if not self.differing:
            return ids, [True] * len(texts)
        return ids, [self.differing.isdisjoint(words) for words in split]

    def split(self, text: str) -> list[str]:
        """The words of a text, normalised, each without its first mark."""
        if not text:
            return []
        if self.plain and "  " not in text and text[0] != " ":
            return text.split(" ") if MARK not in text else self.marked(MARK + text.replace(" ", MARK))
        return self.marked(self.normalizer.normalize_str(text))

    def marked(self, normal: str) -> list[str]:
        return [w[1:] for w in self.word.findall(normal)]

    def learn(self, words: list[str]) -> None:
        """Encode new words, in blocks for the library's threads, and compare them with the original library."""
        blocks = [words[i : i + BLOCK_WORDS] for i in range(0, len(words), BLOCK_WORDS)]
        coded = self.tokenizer.encode_batch([[MARK + w for w in b] for b in blocks], is_pretokenized=True, add_special_tokens=False)
        for block, own in zip(blocks, coded, strict=True):
            ids = np.array(own.ids, dtype=np.int32)
            ends = np.cumsum(np.bincount(np.array(own.word_ids, dtype=np.int64), minlength=len(block))) * 4
            data = ids.tobytes()
            found = [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            self.words.update(zip(block, found, strict=True))
            # the original adds the first mark itself; only blocks that differ are looked at word by word
            same = [w.replace(MARK, " ") for w in block]
            if "" in same or self.original.encode(" ".join(same)) != own.ids:
                each = self.original.encode(same, num_threads=1)
                self.differing.update(
                    w for w, a, b in zip(block, each, found, strict=True) if w and a != np.frombuffer(b, dtype=np.int32).tolist()
                )

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, put together from what the library's decoder gives for each id, and bytes as they are.

        Where the bytes make no valid text the library decodes the whole.
        """
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        try:
            text = self.letters[at].tobytes().decode("utf-8")
        except UnicodeDecodeError:
            return self.decoder.decode([self.model.pieces[i][0] for i in ids.tolist()])
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def agrees(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the original library gives the same ids."""
        return [a == b for a, b in zip(self.original.encode(texts, num_threads=1), ids, strict=True)]


def parts(texts: list[str], batch_chars: int) -> Iterator[list[str]]:
    """Runs of texts of about ``batch_chars`` characters, so that what is worked on at a time is bounded by the longest text."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= batch_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


@cache
def codec(path: str, threads: int = THREADS) -> Codec:
    """One codec per Python worker."""
    return Codec(path, threads)


ENCODED = "ids array<int>, n_byte_pieces bigint, parity boolean"


def encode(text: Column, path: str, threads: int = THREADS, batch_chars: int = BATCH_CHARS) -> Column:
    """A struct of the text's ids, how many of them are single bytes, and whether the original library agrees."""

    def work():
        own = codec(path, threads)

        def handle(texts: pa.Array) -> pa.Array:
            ids, same = [], []
            for part in parts([t or "" for t in texts.to_pylist()], batch_chars):
                more, agree = own.encode(part)
                ids += more
                same += agree
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            by_byte = pa.array([int(own.is_byte[i].sum()) for i in ids], pa.int64())
            return pa.StructArray.from_arrays([lists, by_byte, pa.array(same)], ["ids", "n_byte_pieces", "parity"])

        return handle

    return by_slices(text, ENCODED, work)


def decode(ids: Column, path: str, threads: int = THREADS) -> Column:
    """The text of a list of ids; null as empty."""

    def work():
        own = codec(path, threads)
        return lambda lists: pa.array([own.decode(i.values.to_numpy()) if i.is_valid else "" for i in lists], pa.string())

    return by_slices(ids, "string", work)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: (doc_id, ids, n_tokens, n_byte_pieces, parity).

    ``path`` names a model file present on every executor. ``parity`` says that
    the original library gives the same ids; it is checked when a word first
    occurs in a worker, or on whole texts where pieces may cross words.

    A null or empty text has no ids. Whole texts are encoded, in batches of bounded
    size. Rows are encoded one by one: repeated rows and null doc_ids come back as
    they are, an empty table gives an empty result, other columns are not read.
    There is no shuffle.
    """
    coded = docs.select(col(id_col).alias("doc_id"), encode(text_of(text_col), path).alias("coded"))
    return coded.select("doc_id", "coded.ids", F.size("coded.ids").cast("bigint").alias("n_tokens"), "coded.n_byte_pieces", "coded.parity")
