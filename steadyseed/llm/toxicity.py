"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from steadyseed.llm.common import by_slices, col, held_out, saved, text_of, training_rows

FIT_ROWS = 20_000
MODULUS, HELD_REMAINDER = 4, 2
THRESHOLD = 0.3
LEARNED_WORDS, LEARNED_STEMS = 1000, 100  # at most so many insults and beginnings of insults are learned
LEAST_DOCS, LEAST_PRECISION = 5, 0.8
STEM_LETTERS = (5, 6, 7, 8)
SEED_WEIGHT = 2.0
NEGATION_REACH = 3

# The words of the grammar's classes, English first, then German, French and Spanish.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile fool fools "
    "bastard bitch asshole jerk pig vermin filth retard dumbass scumbag "
    "idioten dummkopf blöd arschloch schwein abschaum "
    "imbécile connard crétin salaud ordure abruti "
    "idiota estúpido estúpida imbécil basura cabrón escoria"
).split()
THREATS = (
    "kill hurt destroy murder stab shoot beat burn hang strangle "
    "töten umbringen schlagen verletzen tuer frapper brûler matar golpear quemar"
).split()
TARGETS = (
    "you your you're youre he she him her they them their his u "
    "du dich dir dein ihr euch sie er tu toi te ton vous votre il elle eux usted tú ti tus ustedes él ella ellos"
).split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't didn't won't nicht kein keine nie pas jamais ne nunca jamás ni".split()
REPORTS = (
    "said says say wrote writes claimed claims reported reports called quoted quotes according told "
    "sagte sagt schrieb berichtete dit écrit déclaré dijo dice escribió"
).split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLAUSE = re.compile(r"[.!?;:,()\n\"“”«»]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


@dataclass(frozen=True)
class Machine:
    """A transducer over word classes: a word's class and the state give the next state and a factor for the word's weight."""

    states: int
    step: Callable[[int, int], tuple[int, float]]


def insult_machine() -> Machine:
    """Insults count whole, further ones in a clause by half; a threat is not its business."""
    return Machine(2, lambda s, c: (1, 0.5 if s else 1.0) if c == INSULT else (s, 1.0))


def target_machine() -> Machine:
    """Remembers a person addressed: insults then weigh more, and threats only count much if somebody is threatened."""
    def step(s: int, c: int) -> tuple[int, float]:
        if c == TARGET:
            return 1, 1.0
        if c == INSULT:
            return s, 1.5 if s else 1.0
        return s, (1.0 if s else 0.1) if c == THREAT else 1.0

    return Machine(2, step)


def threat_machine() -> Machine:
    """A threat that follows another adds half."""
    return Machine(2, lambda s, c: (1, 0.5 if s else 1.0) if c == THREAT else (s, 1.0))


def negation_machine() -> Machine:
    """A negation weakens what follows within a few words."""
    def step(s: int, c: int) -> tuple[int, float]:
        return (NEGATION_REACH, 1.0) if c == NEGATION else (max(s - 1, 0), 0.4 if s else 1.0)

    return Machine(NEGATION_REACH + 1, step)


def report_machine() -> Machine:
    """After a verb of reporting the clause is somebody else's."""
    return Machine(2, lambda s, c: (1, 1.0) if c == REPORT else (s, 0.6 if s else 1.0))


def compose(*machines: Machine) -> tuple[list[list[int]], list[list[float]]]:
    """All machines run in step: next state and product of factors by state and class. State 0 begins a clause."""
    sizes = [m.states for m in machines]
    moves, factors = [], []
    for state in np.ndindex(*sizes):
        arcs = [[m.step(s, c) for m, s in zip(machines, state, strict=True)] for c in range(6)]
        moves.append([int(np.ravel_multi_index([s for s, _ in a], sizes)) for a in arcs])
        factors.append([float(np.prod([f for _, f in a])) for a in arcs])
    return moves, factors


class Grammar:
    """The composed transducer with its lexicon."""

    def __init__(self, insults: dict[str, float], stems: dict[str, float]):
        self.weights = dict.fromkeys(INSULTS, SEED_WEIGHT) | insults | dict.fromkeys(THREATS, SEED_WEIGHT)
        self.stems = stems
        self.classes = (
            dict.fromkeys(REPORTS, REPORT) | dict.fromkeys(NEGATIONS, NEGATION) | dict.fromkeys(TARGETS, TARGET)
            | dict.fromkeys(THREATS, THREAT) | dict.fromkeys([*INSULTS, *insults], INSULT)
        )
        self.moves, self.factors = compose(
            insult_machine(), target_machine(), threat_machine(), negation_machine(), report_machine()
        )
        self.found = ahocorasick.Automaton()
        for word in [*self.weights, *stems]:
            self.found.add_word(word, word)
        self.found.make_automaton()

    def arc(self, token: str) -> tuple[int, float]:
        """A word's class and weight."""
        kind = self.classes.get(token)
        if kind is None:
            weight = max((self.stems[token[:n]] for n in STEM_LETTERS if token[:n] in self.stems), default=0.0)
            return (INSULT, weight) if weight else (OTHER, 0.0)
        return kind, self.weights.get(token, 0.0)

    def clause(self, text: str) -> float:
        """The weight of a clause in lower case."""
        state, total = 0, 0.0
        for token in TOKEN.findall(text):
            kind, weight = self.arc(token)
            if weight:
                total += weight * self.factors[state][kind]
            state = self.moves[state][kind]
        return total

    def features(self, text: str | None) -> tuple[float, float, float]:
        """The heaviest clause, all clauses, and clauses with any weight, damped by logarithms; most texts match nothing."""
        lower = (text or "").lower()
        if next(self.found.iter(lower), None) is None:
            return 0.0, 0.0, 0.0
        weights = [self.clause(c) for c in CLAUSE.split(lower)]
        return float(np.log1p(max(weights))), float(np.log1p(sum(weights))), float(np.log1p(sum(w > 0 for w in weights)))


@dataclass
class ToxicityModel:
    """The learned insults and stems, and a logistic curve over the clause features."""

    insults: dict[str, float]
    stems: dict[str, float]
    coefficients: np.ndarray

    def grammar(self) -> Grammar:
        return Grammar(self.insults, self.stems)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> np.ndarray:
    """Coefficients (the intercept first) of a logistic regression with a quadratic penalty, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _weight(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """How much more often toxic documents have something, as a logarithm of odds within 0.5 to 4."""
    odds = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1))
    return float(np.clip(odds, 0.5, 4.0))


def learn_insults(sample: DataFrame, words: int = LEARNED_WORDS, stems: int = LEARNED_STEMS) -> tuple[dict[str, float], dict[str, float]]:
    """Words, and first letters of words, that mark toxic documents of the sample, with log-odds weights.

    Spark counts the documents per word or stem and label. Words must be telling by
    themselves. Stems may also occur in clean documents; of stems, those that mark
    most documents are taken first, and one that begins with or is the beginning of
    a taken one is left.
    """
    total = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    all_toxic, all_clean = int(total[0] or 0), int(total[1] - (total[0] or 0))
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\W\d_]+(?:['’][^\W\d_]+)*"), F.lit(0)))
    found = sample.select("label", tokens.alias("tokens"))

    def counted(each: Column) -> DataFrame:
        rows = found.select("label", F.explode(each).alias("word"))
        return rows.groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).where(F.col("toxic") >= LEAST_DOCS)

    precise = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1) >= LEAST_PRECISION
    best = [(F.col("toxic") - F.col("clean")).desc(), F.col("word")]
    own = {r.word: _weight(r.toxic, r.clean, all_toxic, all_clean) for r in counted(F.col("tokens")).where(precise).orderBy(*best).limit(words).collect()}

    begun = F.array_distinct(F.flatten(F.transform("tokens", lambda w: F.transform(
        F.filter(F.array(*[F.lit(n) for n in STEM_LETTERS]), lambda n: n < F.length(w)), lambda n: F.substring(w, F.lit(1), n)
    ))))
    # a stem must mark at least one toxic document in a hundred, and toxic ones three times as often as clean ones
    lift = F.col("toxic") / F.lit(float(max(all_toxic, 1))) >= 3 * F.col("clean") / F.lit(float(max(all_clean, 1)))
    common = counted(begun).where(lift & (F.col("toxic") >= F.lit(max(all_toxic, 1) / 100)))
    gain = (F.col("toxic") / F.lit(float(max(all_toxic, 1))) - F.col("clean") / F.lit(float(max(all_clean, 1)))).desc()
    taken: dict[str, float] = {}
    for r in common.orderBy(gain, F.length("word").desc(), "word").limit(4 * stems).collect():
        if len(taken) < stems and not any(t.startswith(r.word) or r.word.startswith(t) for t in taken):
            taken[r.word] = _weight(r.toxic, r.clean, all_toxic, all_clean)
    return own, taken


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> ToxicityModel:
    """Learn insults and the curve from at most ``rows`` labelled documents outside the held-out part.

    Without labels of both classes the curve gives 0.1 to texts that match nothing
    and more to others by the weight of their heaviest clause.
    """
    sample = saved(training_rows(docs, labels, label, held_out(id_col, MODULUS, HELD_REMAINDER), rows, id_col, text_col), "toxicity-sample")
    insults, stems = learn_insults(sample)

    def work():
        grammar = Grammar(insults, stems)
        return lambda texts: pa.array([list(grammar.features(t)) for t in texts.to_pylist()], pa.list_(pa.float64()))

    got = sample.select("label", "doc_id", by_slices(F.col("text"), "array<double>", work).alias("x")).orderBy("doc_id").collect()  # bounded by ``rows``
    y = np.array([r.label for r in got])
    if len(set(y.tolist())) < 2:
        return ToxicityModel(insults, stems, np.array([-2.2, 2.0, 0.0, 0.0]))
    return ToxicityModel(insults, stems, logistic(np.array([r.x for r in got]), y))


def score(text: Column, model: ToxicityModel) -> Column:
    """The probability that the text is toxic."""
    def work():
        grammar, b = model.grammar(), model.coefficients

        def handle(texts: pa.Array) -> pa.Array:
            x = np.array([grammar.features(t) for t in texts.to_pylist()])
            return pa.array(1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30))))

        return handle

    return by_slices(text, "double", work)


def score_documents(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: (doc_id, held_out, score, predicted).

    A null or empty text matches nothing and gets the score of such texts. Null
    doc_ids are never learned from; repeated rows are scored alike; an empty table
    gives an empty result; without labels the built-in words alone decide. Other
    columns of ``docs`` are not read. There is no shuffle but for the bounded sample.
    """
    model = fit(docs, labels, rows=rows, id_col=id_col, text_col=text_col)
    scored = docs.select(
        col(id_col).alias("doc_id"), held_out(id_col, MODULUS, HELD_REMAINDER).alias("held_out"), score(text_of(text_col), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
