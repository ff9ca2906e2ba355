"""Toxicity by a weighted finite-state pattern grammar.

A cascade of transducers. The lexicon, a trie over the characters of a word, writes what a word is (insult, threatening verb, announcement,
target, negation, reporting verb, filler) with a weight; its insults are a few general words and the words and word starts that labels
single out. Of a clause's symbols, an insult transducer joins insults that follow one another to a phrase, a threat transducer tells
announced threats from plain verbs, a target transducer whether the clause is aimed at somebody (before or after the word), a negation
transducer what stands in the reach of a negation, a report transducer whether the clause is reported speech (again before or after),
and a clause acceptor refuses words that stand alone. They are composed to one grammar, which writes for each harmful word of a matched
clause the pattern in which it stands. Weights of patterns are learned from labels around those of the arcs, and a logistic
model over what the matched clauses of a text add up to gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.llm.common import rest, resting, staged, table, tune, unstage
from mdframe.llm.labelled import held_out, sample_ids, with_rows
from mdframe.llm.transducers import NONE, Transducer, compose

#: Labelled rows that a model learns from, at most.
FIT_ROWS = 12_000
FOLDS, FOLD = 4, 2
CUT = 0.3

#: What a word is. A clause is a string of these, closed by END.
FILLER, INSULT, VERB, ANNOUNCED, TARGET, NEGATION, REPORT, END = "witmynr#"
#: What the grammar makes of harmful words: an insult, one more in its phrase, a threat, a threatening verb that nothing announces.
PHRASE, MORE, THREAT, BARE = "IJTV"
HARM = (PHRASE, MORE, THREAT, BARE)
AIMED, DENIED, REPORTED = "@~'"

#: General words of the languages served; what they weigh is learned.
WORDS = {
    NEGATION: "not never no none neither nor without nicht kein keine nie ne pas jamais sans nunca sin tampoco".split(),
    REPORT: "said says say wrote writes quoted quote called claimed reported according sagte sagt schrieb dit disait écrit dijo dice escribió".split(),
    TARGET: "you your yours u ur du dich dir dein deine euch tu toi te vous votre usted ustedes tú vos".split(),
    ANNOUNCED: "will gonna going shall must should werde werden muss sollte vais allons veux voy vamos quiero".split(),
    INSULT: "idiot idiots moron morons stupid scum trash loser losers pathetic disgusting worthless clown dumb imbecile".split(),
    VERB: "kill hurt destroy punch stab shoot beat umbringen töten tuer frapper matar golpear".split(),
}
PRIOR = 1.0
_TOKENS = re.compile(r"[^\W_]+|[.!?;\n]")
_LONG_GAP = re.compile(f"{FILLER}{{5,}}")
PREFIXES = range(4, 9)
#: A form is of the lexicon from so many toxic rows on, and from this log odds ratio and its standard score.
LEAST_ROWS, LEAST_ODDS, LEAST_Z = 4, 1.7, 3.3
#: Words of a negation's reach, and between an announcement and its verb.
REACH, NEAR = 3, 2
#: Words that a task remembers, at most.
WORDS_KEPT = 200_000


class Lexicon:
    """The transducer of words: a trie over characters with entries for whole words and word starts (``*``); the longest entry wins."""

    def __init__(self, entries: dict[str, tuple[str, float]]) -> None:
        self.entries = entries
        self._grow()

    def _grow(self) -> None:
        self.known: dict[str, tuple[str, float]] = {}
        self.next: list[dict[str, int]] = [{}]
        self.whole: dict[int, tuple[str, float]] = {}
        self.started: dict[int, tuple[str, float]] = {}
        for entry, out in self.entries.items():
            state = 0
            for c in entry.removesuffix("*"):
                to = self.next[state].get(c)
                if to is None:
                    to = self.next[state][c] = len(self.next)
                    self.next.append({})
                state = to
            (self.started if entry.endswith("*") else self.whole)[state] = out

    def __getstate__(self):
        return {"entries": self.entries}

    def __setstate__(self, state):
        self.entries = state["entries"]
        self._grow()

    def read(self, word: str) -> tuple[str, float]:
        """Symbol and weight of a word."""
        out = self.known.get(word)
        if out is None:
            state, best = 0, (FILLER, 0.0)
            for k, c in enumerate(word):
                state = self.next[state].get(c)
                if state is None:
                    break
                if k + 1 < len(word):
                    best = self.started.get(state, best)
            else:
                best = self.whole.get(state, best)
            out = best
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            self.known[word] = out
        return out


def _same(state, symbols, to=None, weight=0.0) -> list[tuple]:
    return [(state, s, s, weight, state if to is None else to) for s in symbols]


def insult_transducer(more: float = -0.3) -> Transducer:
    """An insult begins a phrase; the next word, if an insult too, goes on with it."""
    others = (FILLER, VERB, ANNOUNCED, TARGET, NEGATION, REPORT, END)
    arcs = _same(0, others) + _same(1, others, 0) + [(0, INSULT, PHRASE, 1.0, 1), (1, INSULT, MORE, 1.0 + more, 1)]
    return Transducer.of(0, arcs, (0, 1))


def threat_transducer(bare: float = -0.7) -> Transducer:
    """A threatening verb at most ``NEAR`` words after an announcement is a threat; any other weighs less."""
    arcs = []
    others = (FILLER, PHRASE, MORE, TARGET, NEGATION, REPORT, END)
    for left in range(NEAR + 1):
        arcs += _same(left, others, max(0, left - 1))
        arcs.append((left, ANNOUNCED, FILLER, 0.0, NEAR))
        arcs.append((left, VERB, THREAT if left else BARE, 1.0 if left else 1.0 + bare, max(0, left - 1)))
    return Transducer.of(0, arcs, range(NEAR + 1))


def _whole_clause(marker: str, mark: str, weight: float, harm: tuple, others: tuple) -> Transducer:
    """Marks the harmful words of clauses that hold ``marker`` anywhere: the start guesses whether it does, and the end allows only true guesses."""
    arcs = []
    for guess, first in (("without", "without"), ("with", "unseen")):
        for state in {first, "seen"} if guess == "with" else {first}:
            arcs += _same(state, others)
            arcs += [(state, h, h + mark if guess == "with" else h, weight if guess == "with" else 0.0, state) for h in harm]
            if guess == "with":
                arcs.append((state, marker, FILLER, 0.0, "seen"))
    arcs += [("start", symbol, written, w, to) for state, symbol, written, w, to in arcs if state in ("without", "unseen")]
    return Transducer.of("start", arcs, ("start", "without", "seen"))


def target_transducer(aimed: float = 0.5) -> Transducer:
    """Harmful words of a clause with a target, before or after them, are aimed."""
    return _whole_clause(TARGET, AIMED, aimed, HARM, (FILLER, NEGATION, REPORT, END))


def negation_transducer(denied: float = -0.6) -> Transducer:
    """Harmful words at most ``REACH`` words after a negation are denied."""
    harm = [h + a for h in HARM for a in ("", AIMED)]
    arcs = []
    for left in range(REACH + 1):
        after = max(0, left - 1)
        arcs += _same(left, (FILLER, REPORT, END), after) + [(left, NEGATION, FILLER, 0.0, REACH)]
        arcs += [(left, h, h + DENIED if left else h, denied if left else 0.0, after) for h in harm]
    return Transducer.of(0, arcs, range(REACH + 1))


def report_transducer(reported: float = -0.4) -> Transducer:
    """Harmful words of a clause with a reporting verb, before or after them, are reported."""
    harm = tuple(h + a + d for h in HARM for a in ("", AIMED) for d in ("", DENIED))
    return _whole_clause(REPORT, REPORTED, reported, harm, (FILLER, END))


def clause_acceptor() -> Transducer:
    """Refuses clauses of one word, and writes nothing but the harmful words' patterns."""
    harm = [h + a + d + r for h in HARM for a in ("", AIMED) for d in ("", DENIED) for r in ("", REPORTED)]
    arcs = [(n, s, NONE if s == FILLER else s, 0.0, min(2, n + 1)) for n in range(3) for s in (FILLER, *harm)] + [(2, END, NONE, 0.0, "end")]
    return Transducer.of(0, arcs, ("end",))


class Grammar:
    """The composed grammar: ``patterns`` with the weights of their arcs, and ``read`` for clauses."""

    def __init__(self) -> None:
        self.machine = reduce(compose, (
            insult_transducer(), threat_transducer(), target_transducer(), negation_transducer(), report_transducer(), clause_acceptor(),
        ))
        weights = {out: w for by in self.machine.arcs.values() for arcs in by.values() for out, w, _ in arcs if out != NONE}
        self.patterns = sorted(weights)
        self.weights = np.array([max(0.1, weights[p]) for p in self.patterns])
        self.index = {p: k for k, p in enumerate(self.patterns)}
        self.known: dict[str, list[int]] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def read(self, clause: str) -> list[int]:
        """For each harmful word of a clause (without END) the number of its pattern; nothing where the clause does not match."""
        clause = _LONG_GAP.sub(FILLER * 4, clause)  # no transducer looks farther
        out = self.known.get(clause)
        if out is None:
            found = self.machine.best(clause + END)
            out = [self.index[p] for p in found[1]] if found else []
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[clause] = out
        return out


def read_text(text: str | None, lexicon: Lexicon, grammar: Grammar) -> tuple[list[list[tuple[int, float]]], int]:
    """Of a whole text its matched clauses, each as (pattern, weight of the word) of its harmful words, and its number of words."""
    tokens = _TOKENS.findall(text.lower()) if text else ()
    known, read = lexicon.known, lexicon.read
    symbols = [known.get(w) or (read(w) if w.isalnum() else (END, 0.0)) for w in tokens]
    line = "".join([s[0] for s in symbols])
    words = len(line) - line.count(END)
    if INSULT not in line and VERB not in line:
        return [], words
    weights = iter([s[1] for s in symbols if s[0] in (INSULT, VERB)])
    clauses = []
    for clause in line.split(END):
        harmful = clause.count(INSULT) + clause.count(VERB)
        if harmful:
            own = [next(weights) for _ in range(harmful)]
            found = grammar.read(clause)
            if found:
                clauses.append(list(zip(found, own, strict=True)))
    return clauses, words


def sums(clauses: list, patterns: int) -> np.ndarray:
    """For each pattern the sum of its words' weights."""
    out = np.zeros(patterns)
    for clause in clauses:
        for k, w in clause:
            out[k] += w
    return out


def statistics(clauses: list, words: int, weights: np.ndarray) -> list[float]:
    """Of the matched clauses under weights of patterns: log sum, density, largest clause, share of words, and the log number of words."""
    counts = [sum(w * weights[k] for k, w in clause) for clause in clauses]
    total, hits = sum(counts), sum(map(len, clauses))
    return [math.log1p(total), min(50.0, 100 * total / max(1, words)), max(counts, default=0.0), 100 * hits / max(1, words), math.log1p(words)]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30, around: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic model by Newton steps, drawn to ``around`` (zeros); the last is the intercept, which is free."""
    a = np.c_[x, np.ones(len(x))]
    prior = np.zeros(a.shape[1]) if around is None else np.r_[around, 0.0]
    w = prior.copy()
    keep = penalty * np.eye(a.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + keep, a.T @ (y - p) - keep @ (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_patterns(x: np.ndarray, y: np.ndarray, arcs: np.ndarray) -> np.ndarray:
    """Weights of patterns from log sums of each pattern's words (and the log number of words in the last column of ``x``).

    They are drawn to the weights of the grammar's arcs, on the scale of the patterns that the labels speak of most; what none speaks of keeps its weight.
    """
    seen = (x[:, :-1] > 0).sum(axis=0)
    scale = fit_logistic(np.c_[x[:, :-1] @ arcs, x[:, -1]], y)[0]
    for _ in range(4):
        if scale <= 0 or not seen.any():
            return arcs
        learned = fit_logistic(x, y, around=np.r_[scale * arcs, 0.0])[:-2]
        used, scale = scale, float(seen @ learned / (seen @ arcs))
    return np.clip(learned / used, 0.25 * arcs, 4 * arcs)


def forms_of(text: str) -> set[str]:
    """Words of a text and their starts."""
    forms = set()
    for w in set(_TOKENS.findall(text.lower())):
        if w.isalnum():
            forms.add(w)
            forms.update(w[:k] + "*" for k in PREFIXES if len(w) > k)
    return forms


def count_forms(rows: DataFrame) -> DataFrame:
    """``(side, y, form, n)``: in how many rows ``(side, y, text)`` a form stands, counted in tasks before anything is sent."""
    def run(it):
        for batch in it:
            seen: Counter = Counter()
            for side, y, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                seen.update((side, y, f) for f in forms_of(text))
            side, y, form = zip(*seen, strict=True) if seen else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(side, pa.int32()), pa.array(y, pa.int32()), pa.array(form, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["side", "y", "form", "n"]
            )

    counted = rows.select("side", "y", "text").mapInArrow(resting(run), "side int, y int, form string, n long")
    return counted.groupBy("side", "y", "form").agg(F.sum("n").alias("n"))


def odds_of(h1, h0, n1: int, n0: int):
    """Log odds ratio of a form of ``h1`` of ``n1`` toxic rows and ``h0`` of ``n0`` others, and its standard score; columns or numbers."""
    log, root = (F.log, F.sqrt) if not isinstance(h1, int | float) else (math.log, math.sqrt)
    odds = log((h1 + 0.5) / (n1 + 1)) - log((h0 + 0.5) / (n0 + 1))
    return odds, odds / root(1 / (h1 + 0.5) + 1 / (h0 + 0.5))


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """Lexicons of the rows of side 0, of side 1, and of all: general words plus forms that labels single out.

    Forms are counted where the texts are; those that qualify are what reaches the driver, at most a part of the words of the rows.
    """
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("side", "y").count().collect()}
    of = lambda side, y: F.coalesce(F.sum(F.when((F.col("side") == side) & (F.col("y") == y), F.col("n"))), F.lit(0))
    forms = count_forms(rows).groupBy("form").agg(*[of(s, y).alias(f"h{s}{y}") for s in (0, 1) for y in (0, 1)])
    views = []
    for sides in ((0,), (1,), (0, 1)):
        n1, n0 = (sum(sizes.get((s, y), 0) for s in sides) for y in (1, 0))
        h1, h0 = (reduce(lambda a, b: a + b, [F.col(f"h{s}{y}") for s in sides]) for y in (1, 0))
        odds, z = odds_of(h1, h0, n1, n0)
        views.append(F.when((h1 >= LEAST_ROWS) & (odds > LEAST_ODDS) & (z > LEAST_Z), odds))
    found = forms.select("form", *[v.alias(f"o{k}") for k, v in enumerate(views)]).where("coalesce(o0, o1, o2) is not null").collect()
    out = []
    for k in range(3):
        entries = {w: (s, PRIOR if s in (INSULT, VERB) else 0.0) for s, words in WORDS.items() for w in words}
        for r in sorted(found):
            if r[k + 1] is not None:
                symbol = entries.get(r[0], (INSULT, 0))[0]
                if symbol in (INSULT, VERB):
                    entries[r[0]] = (symbol, r[k + 1])
        out.append(Lexicon(entries))
    return out


class ToxicityModel:
    """Lexicon, grammar, weights of patterns, and the logistic weights over a text's clause statistics."""

    def __init__(self, lexicon: Lexicon, grammar: Grammar, patterns: np.ndarray, weights: np.ndarray) -> None:
        self.lexicon, self.grammar, self.patterns, self.weights = lexicon, grammar, patterns, weights

    def score(self, text: str | None) -> float:
        z = float(np.dot(statistics(*read_text(text, self.lexicon, self.grammar), self.patterns), self.weights[:-1]) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> ToxicityModel:
    """Learn from at most ``most`` labelled rows outside the held-out fold. Without both labels every score is the share of label 1.

    Half of the rows give the lexicon and the other half the weights, and the other way round: statistics of a text never come
    from a lexicon that has seen it. Texts stay in tasks; the driver sees the forms that qualify and the matched clauses of each row. Of rows
    that share an id one counts, and a null text counts as empty.
    """
    grammar = Grammar()
    ids = sample_ids(labels, "toxic", FOLDS, FOLD, most)
    rows = with_rows(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), ids)
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    rows = staged(rows.select("doc_id", F.col("y").cast("int").alias("y"), side.alias("side"), "text"), "toxic-rows")
    shares = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if len(shares) < 2:
        share = float(np.clip(next(iter(shares), 0) if shares else 0.01, 0.01, 0.99))
        unstage(rows)
        return ToxicityModel(Lexicon({}), grammar, grammar.weights, np.array([0.0] * 5 + [math.log(share / (1 - share))]))
    lexicons = learn_lexicons(rows)
    crossed = lexicons[1], lexicons[0]

    def seen(of) -> tuple[np.ndarray, np.ndarray]:
        """``of`` a text's clauses and words for each row, read by the lexicon of the other side; and the labels."""
        def run(it):
            for batch in it:
                found = [of(*read_text(t, crossed[s], grammar)) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(map(float, f)) for f in found], pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

        got = sorted(rows.mapInArrow(resting(run), "doc_id long, y int, x array<double>").collect())
        return np.array([r[2] for r in got]), np.array([float(r[1]) for r in got])

    x, y = seen(lambda clauses, words: [*np.log1p(sums(clauses, len(grammar.patterns))), math.log1p(words)])
    patterns = learn_patterns(x, y, grammar.weights)
    x, y = seen(lambda clauses, words: statistics(clauses, words, patterns))
    unstage(rows)
    return ToxicityModel(lexicons[2], grammar, patterns, fit_logistic(x, y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row, from its whole text alone; null and empty texts get the score of no clause.

    A text is read in one pass, however long; repeated rows and rows that share an id each have their own row, equal texts equal scores.
    """
    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"]
            )

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("t"))
    return rows.mapInArrow(resting(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, with all their columns."""
    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            yield pa.array([model.score(t.as_py()) for t in text], pa.float64())  # one text at a time
        rest()

    return docs.where(scored(F.col("text").cast("string")) < cut)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a row for each row, whatever its id or text (see :func:`score_toxicity`)."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
