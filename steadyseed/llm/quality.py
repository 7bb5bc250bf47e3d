"""Text quality by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.llm.common import by_slices, col, held_out, saved, text_of, training_rows, unused

FIT_ROWS = 20_000
MODULUS, HELD_REMAINDER = 5, 0
THRESHOLD = 0.3
OWN_COVARIANCE, RIDGE = 0.5, 0.02
STATISTICS = [
    "words", "word_length", "capitals", "digits", "symbols", "punctuation", "breaks", "distinct_words", "stutter",
    "distinct_lines", "line_words", "top_letter", "capital_words", "separators",
]
LEAST = 1e-3  # added to a share before its logarithm


def _kinds() -> np.ndarray:
    """For each byte value, whether it is a capital, a digit, a symbol, a stop, white space or a separator."""
    table = np.zeros((256, 6))
    for kind, letters in enumerate((
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*+<=>@^~_{}", ".,;:!?'\"-()", " \t\n\r\x0b\x0c", "|/\\[]\t"
    )):
        table[[ord(x) for x in letters], kind] = 1
    return table


KINDS = _kinds()


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text: logarithms of counts and of shares. All are finite for any text."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size = max(int(counts.sum()), 1)
    capitals, digits, symbols, stops, breaks, separators = (counts @ KINDS) / size
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x] or [""]
    letters = counts.copy()
    letters[[9, 10, 11, 12, 13, 32]] = 0
    share = lambda x: float(np.log(x + LEAST))
    return [
        float(np.log1p(len(words))),
        float(np.log1p(sum(map(len, words)) / n)),
        share(capitals), share(digits), share(symbols), share(stops), share(breaks),
        float(np.log(max(len(set(words)), 1) / n**0.9)),
        share(sum(map(eq, words, words[1:])) / n),
        share(len(set(lines)) / len(lines)),
        float(np.log1p(n / len(lines))),
        share(letters.max() / size),
        share(sum(map(str.istitle, words)) / n),
        share(separators),
    ]


@dataclass
class Discriminant:
    """Two Gaussians with shrunken covariances, kept as means, inverse Cholesky factors and constants."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, own: float = OWN_COVARIANCE, ridge: float = RIDGE) -> Discriminant | None:
        """Each class's covariance is ``own`` of its own and the rest of the pooled one, then drawn to a multiple of the unit by ``ridge``.

        None if a class has fewer than two rows.
        """
        groups = [x[y == k] for k in (0, 1)]
        if min(map(len, groups)) < 2:
            return None
        each = [np.cov(g, rowvar=False) for g in groups]
        pooled = sum(c * (len(g) - 1) for c, g in zip(each, groups, strict=True)) / (len(x) - 2)
        means, factors, constants = [], [], []
        for group, cov in zip(groups, each, strict=True):
            cov = own * cov + (1 - own) * pooled
            cov = (1 - ridge) * cov + (ridge * np.trace(cov) / len(cov) + 1e-9) * np.eye(len(cov))
            lower = np.linalg.cholesky(cov)
            means.append(group.mean(axis=0))
            factors.append(np.linalg.inv(lower))
            constants.append(np.log(len(group) / len(x)) - np.log(np.diag(lower)).sum())
        return cls(np.array(means), np.array(factors), np.array(constants))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1, from the difference of the log densities."""
        logs = [
            c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -50.0, 50.0)))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> Discriminant | None:
    """Learn from at most ``rows`` labelled documents outside the held-out part; None where a class is missing."""
    sample = training_rows(docs, labels, label, held_out(id_col, MODULUS, HELD_REMAINDER), rows, id_col, text_col)

    def work():
        return lambda texts: pa.array([statistics(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    measured = saved(sample.select("doc_id", "label", by_slices(F.col("text"), "array<double>", work).alias("x")), "quality-sample")
    got = measured.orderBy("doc_id").collect()  # bounded by ``rows``
    if not got:
        return None
    return Discriminant.fit(np.array([r.x for r in got]), np.array([r.label for r in got]))


def score(text: Column, model: Discriminant | None) -> Column:
    """The probability that the text's label is 1; one half without a model."""
    if model is None:
        return F.lit(0.5)

    def work():
        return lambda texts: pa.array(model.score(np.array([statistics(t) for t in texts.to_pylist()])))

    return by_slices(text, "double", work)


def score_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: (doc_id, held_out, score, predicted).

    A null or empty text is scored by the statistics of an empty text. Null doc_ids
    are never learned from; repeated rows are scored alike; without labels of both
    classes every score is 0.5; an empty table gives an empty result. Other columns
    of ``docs`` are not read. There is no shuffle but for the bounded sample.
    """
    model = fit(docs, labels, rows=rows, id_col=id_col, text_col=text_col)
    scored = docs.select(
        col(id_col).alias("doc_id"), held_out(id_col, MODULUS, HELD_REMAINDER).alias("held_out"), score(text_of(text_col), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with the columns of ``docs``."""
    (name,) = unused(docs, "__score")
    model = fit(docs, labels, rows=rows, id_col=id_col, text_col=text_col)
    return docs.withColumn(name, score(text_of(text_col), model)).where(F.col(name) >= threshold).drop(name)
