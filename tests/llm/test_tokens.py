import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from steadyseed.llm import sentence_pieces, token_counts
from tests.llm.conftest import ODD

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  a  b ", "Hello's we'll IT'S 123 45,6", "Σας ΟΔΥΣΣΕΥΣ İstanbul ﬁ ①② é", "<|endoftext|>x<|startoftext|> <|endo", "\x85a\x1cb c​d e",
    "日本語テキスト 中文 한국어", "\x00\x01 a", "a" * 5000, "''s''ll'", "¿¡ñ ç Ⅷ ²³ ½ x²", "́a ́", "a▁b ▁▁ c", "<s> </s> <0x41>", "🤗🤗",
]


@pytest.fixture(scope="module")
def texts(spark, tables):
    return TEXTS + [r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]


def test_counts_equal_the_library(texts):
    library = Tokenizer.from_file(VOCABULARY)
    counter = token_counts.counter(VOCABULARY)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want
    for chunk in (7, 64):
        assert [counter.count(t, chunk) for t in texts[:40]] == want[:40]


def test_forgetting_changes_no_count(monkeypatch):
    monkeypatch.setattr(token_counts, "STATES_KEPT", 20)
    monkeypatch.setattr(token_counts, "WORDS_KEPT", 3)
    counter = token_counts.TokenCounter(VOCABULARY)
    library = Tokenizer.from_file(VOCABULARY)
    for t in TEXTS:
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids)


def test_odd_rows_are_counted(odd, none):
    got = token_counts.count_tokens(odd, VOCABULARY, limit=3).collect()
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 3) for i, t, _ in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(none, VOCABULARY).count() == 0


def test_pieces_equal_the_original(texts):
    own, original = sentence_pieces.codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids, same = own.encode(texts)
    assert [i.tolist() for i in ids] == original.encode(texts)
    assert all(same)
    plain = [t for t in texts if "▁" not in t]
    assert [own.decode(i) for i, t in zip(ids, texts, strict=True) if "▁" not in t] == plain
    whole = sentence_pieces.build(own.model).encode_batch(texts, add_special_tokens=False)
    assert [e.ids for e in whole] == [i.tolist() for i in ids]


def test_broken_bytes_decode_like_the_library():
    own = sentence_pieces.codec(MODEL)
    ids = sentence_pieces.np.array([3 + 0xE6, 3 + 0x97, 300, 3 + 0x41])
    assert own.decode(ids) == sentence_pieces.build(own.model).decode(ids.tolist(), skip_special_tokens=False)


def test_odd_rows_round_trip(odd, none):
    coded = sentence_pieces.encode_documents(odd, MODEL)
    got = coded.withColumn("text", sentence_pieces.decode(coded.ids, MODEL)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t or "") for i, t, _ in ODD)
    assert all(r.parity and r.n_tokens == len(r.ids) for r in got)
    assert sentence_pieces.encode_documents(none, MODEL).count() == 0


def test_every_code_point_is_classed_as_the_library_does():
    """Letters and marks that only some Unicode versions know, too, among letters, digits, marks and signs."""
    library, own = Tokenizer.from_file(VOCABULARY), token_counts.counter(VOCABULARY)
    letters = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    texts = [" ".join(f"x{c}'s !{c}1 a{c}b" for c in letters[i : i + 64]) for i in range(0, len(letters), 64)]
    young = [c for c in letters if own.library.young.match(c)]
    rng = random.Random(2)
    pick = lambda: rng.choice([rng.choice(young), rng.choice("aá\u0301\u0316's1!.ΣÉ"), rng.choice(letters)])
    texts += ["".join(pick() for _ in range(rng.randrange(1, 12))) for _ in range(5000)]
    assert [own.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
