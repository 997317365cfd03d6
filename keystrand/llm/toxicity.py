"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps tokens to classes: negation, report, target, threat, insult, the clause's end, and others. Over
classes run small transducers with explicit states and arcs: one for each of insult, threat, target, negation and reported speech. An
arc's weight says what the transducer makes of a token of that class in its state; weights of 0 block, weights of 1 pass. The
transducers that read forwards are composed into one, so is the one for targets that come later, which reads backwards. Both
together (a bimachine) give every insult and threat its weight; a clause's weights add up to its mass, the clauses' masses
to the document's. Every clause ends in the start state.

The insult arcs are learned: words and word stems (every prefix) whose document frequency among labelled toxic
texts exceeds that among clean ones by log-odds. The other classes hold small closed word lists. What negation and report
leave of a weight starts from a given value and moves with the labelled texts that have such clauses.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Labelled texts the grammar is fitted on, at most; the ones with the least hash of the text where there are more.
MAX_FIT_ROWS = 40_000
#: Stems kept in the lexicon, at most.
MAX_LEXICON = 20_000
#: Shortest and longest prefix that can be a stem.
STEM = (3, 8)
#: Least log-odds of an arc, and most clean texts with it as a share of the toxic ones.
MIN_LOG_ODDS, MAX_CLEAN = 2.0, 0.1
#: Arcs that may pass by chance: the least number of toxic texts an arc needs is the first at which fewer are expected.
CHANCE, MOST_SUPPORT = 0.3, 12

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+")
#: Words, and the characters that end a clause.
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")

NEGATION = frozenset("not no never isn't aren't wasn't don't doesn't nicht kein keine nie pas jamais aucun ne ningún ninguna nunca jamás".split())
REPORTED = frozenset("said says told wrote called quoted claims sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split())
TARGET = frozenset("you your you're he she they him her them du dich dir ihr euch sie ihn tu te toi vous ton votre tú ti usted ustedes vosotros tus".split())
THREAT = frozenset("kill hurt destroy beat shoot stab burn murder töten umbringen schlagen tuer frapper matar golpear".split())
#: What is left of an insult's or threat's weight in a negated or reported clause before any label is seen, and how many
#: labelled texts that is worth.
NEGATED, SPOKEN, BELIEF = 0.5, 0.7, 10.0
#: What a target near an insult makes of its weight, and the weight of a threat word with a target near it.
TARGETED, THREAT_WEIGHT = 1.25, 0.5
#: Tokens over which a target, negation or report governs.
REACH = 5
#: Classes of tokens. Those from EMITTING on have a weight of their own; insults are INSULT plus their number in the lexicon.
OTHER, END, NEGATES, REPORTS, TARGETS, THREATENS, INSULT = range(7)
EMITTING = THREATENS
CLASSES = INSULT + 1


@dataclass
class Transducer:
    """Arcs of a deterministic weighted transducer over token classes: to[state][class] and weight[state][class]; it starts in
    state 0."""

    to: list[list[int]]
    weight: list[list[float]]

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: states are pairs that can be reached, weights multiply."""
        number, found = {(0, 0): 0}, [(0, 0)]
        to: list[list[int]] = []
        weight: list[list[float]] = []
        for a, b in found:  # grows while it is read
            to.append([])
            weight.append([])
            for c in range(CLASSES):
                pair = (self.to[a][c], other.to[b][c])
                if pair not in number:
                    number[pair] = len(found)
                    found.append(pair)
                to[-1].append(number[pair])
                weight[-1].append(self.weight[a][c] * other.weight[b][c])
        return Transducer(to, weight)


def governed(by: int, weights: dict[int, float], otherwise: dict[int, float] | None = None) -> Transducer:
    """States 0 to REACH: tokens for which the last token of class `by` still governs. While it does, classes weigh `weights`, else
    `otherwise`, and those not named 1."""
    to = [[REACH if c == by else 0 if c == END else max(0, k - 1) for c in range(CLASSES)] for k in range(REACH + 1)]
    weight = [[(weights if k else otherwise or {}).get(c, 1.0) for c in range(CLASSES)] for k in range(REACH + 1)]
    return Transducer(to, weight)


def emitter(by: int, weight: float) -> Transducer:
    """One state: gives class `by` its weight and passes the others."""
    return Transducer([[0] * CLASSES], [[weight if c == by else 1.0 for c in range(CLASSES)]])


class Lexicon(dict):
    """The lexical transducer: class of each token, insults by their word or longest stem; remembers tokens, up to a bound."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.weights = [*words.values(), *stems.values()]
        self.words = {w: INSULT + i for i, w in enumerate(words)}
        self.stems = {x: INSULT + len(words) + i for i, x in enumerate(stems)}
        self.closed = dict.fromkeys(".!?;:\n", END) | dict.fromkeys(NEGATION, NEGATES) | dict.fromkeys(REPORTED, REPORTS) | dict.fromkeys(TARGET, TARGETS) | dict.fromkeys(THREAT, THREATENS)

    def __missing__(self, token: str) -> int:
        found = self.words.get(token) or self.closed.get(token)
        if found is None:
            stems = (self.stems.get(token[:k]) for k in range(min(len(token) - 1, STEM[1]), STEM[0] - 1, -1))
            found = next((x for x in stems if x is not None), OTHER)
        if len(self) > 500_000:
            self.clear()
        self[token] = found
        return found


@dataclass
class Grammar:
    """The learned arcs (word or stem -> weight), what negation and report leave of a weight, and the calibration of a
    document's mass to a score."""

    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 1.0
    offset: float = 0.0
    floor: float = 0.01
    negated: float = NEGATED
    spoken: float = SPOKEN

    def __post_init__(self) -> None:
        damped = lambda x: {THREATENS: x, INSULT: x}
        insult, threat = emitter(INSULT, 1.0), emitter(THREATENS, THREAT_WEIGHT)  # an insult's weight comes with its arc
        target = governed(TARGETS, {INSULT: TARGETED, THREATENS: TARGETED}, {THREATENS: 0.0})
        negation, report = governed(NEGATES, damped(self.negated)), governed(REPORTS, damped(self.spoken))
        self.lexicon = Lexicon(self.words, self.stems)
        self.forwards = insult.compose(threat).compose(negation).compose(report)
        self.target = target  # once forwards, once backwards: the nearer one counts

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("lexicon", "forwards", "target")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def codes(self, text: str | None) -> list[int]:
        return list(map(self.lexicon.__getitem__, TOKEN.findall((text or "").lower())))

    def run(self, codes: list[int]) -> float:
        """The bimachine over a text's codes: the sum of all weights of insults and threats."""
        kinds = [min(c, INSULT) for c in codes]
        later: list[float] = []
        state, to, weight = 0, self.target.to, self.target.weight
        for c in reversed(kinds):
            later.append(weight[state][c])
            state = to[state][c]
        total, state, at = 0.0, 0, 0
        for c, code, after in zip(kinds, codes, reversed(later), strict=True):
            if c >= EMITTING:
                near = max(after, weight[at][c])
                total += near * self.forwards.weight[state][c] * (self.lexicon.weights[code - INSULT] if c == INSULT else 1.0)
            state, at = self.forwards.to[state][c], to[at][c]
        return total

    def mass(self, text: str | None) -> float:
        codes = self.codes(text)
        return self.run(codes) if codes and max(codes) >= EMITTING else 0.0

    def clauses(self, text: str | None) -> Iterator[tuple[str, float]]:
        """Matched clauses with their masses."""
        for clause in CLAUSE.split((text or "").lower()):
            if (mass := self.mass(clause)) > 0:
                yield clause.strip(), mass

    def governing(self, text: str | None) -> tuple[bool, bool]:
        """Whether all insults and threats of a text are negated, and whether all are reported; both false if it has none."""
        codes = self.codes(text)
        if not codes or max(codes) < EMITTING:
            return False, False
        out = []
        for by in (NEGATES, REPORTS):
            state, arcs, all_ = 0, governed(by, {}).to, True
            for code in codes:
                c = min(code, INSULT)
                all_ &= c < EMITTING or state > 0
                state = arcs[state][c]
            out.append(all_)
        return out[0], out[1]

    def score(self, text: str | None) -> float:
        m = self.mass(text)
        return self.floor if m <= 0 else 1.0 / (1.0 + math.exp(-(self.slope * math.log1p(m) + self.offset)))


def stems_of(token: str) -> list[str]:
    """Proper prefixes: a stem that stands alone is a word of its own."""
    return [token[:k] for k in range(STEM[0], min(len(token) - 1, STEM[1]) + 1)]


def counted(labelled: DataFrame) -> DataFrame:
    """(arc, toxic, clean): in how many texts of each label a whole word (arc with a trailing space) or stem stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                arcs: set[str] = set()
                for token in set(WORD.findall((text or "").lower())):
                    arcs.add(token + " ")
                    arcs.update(stems_of(token))
                for arc in arcs:
                    tally.setdefault(arc, [0, 0])[0 if toxic else 1] += 1
            if len(tally) > 300_000:
                yield _tallied(tally)
                tally = {}
        yield _tallied(tally)

    parts = labelled.select("text", "toxic").mapInArrow(run, "arc string, toxic bigint, clean bigint")
    return parts.groupBy("arc").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _tallied(tally: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(tally), pa.string()), pa.array([v[0] for v in tally.values()], pa.int64()), pa.array([v[1] for v in tally.values()], pa.int64())],
        names=["arc", "toxic", "clean"],
    )


def fit(labelled: DataFrame, max_rows: int = MAX_FIT_ROWS, max_lexicon: int = MAX_LEXICON) -> Grammar:
    """Learn the lexicon and calibration from rows (text, toxic 0/1); null labels and an empty table teach nothing.

    At most max_rows rows are used (those of least text hash, so the choice is the same on every run). The lexicon brought to
    the driver is the max_lexicon arcs of greatest toxic frequency among those that pass the test.
    """
    labelled = labelled.where("toxic IS NOT NULL").select("text", "toxic")
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    if total > max_rows:
        share = max_rows / total
        labelled = labelled.where(F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
        n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Grammar({}, {}, floor=(n1 + 0.01) / (n1 + n0 + 1.0))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    arcs = cut(counted(labelled), "toxic-arcs")
    by_support = {r["k"]: r["n"] for r in arcs.groupBy((F.col("toxic") + F.col("clean")).alias("k")).agg(F.count("*").alias("n")).where(F.col("k") <= MOST_SUPPORT).collect()}
    least = next((k for k in range(2, MOST_SUPPORT) if by_support.get(k, 0) * (n1 / (n1 + n0)) ** k < CHANCE), MOST_SUPPORT)
    kept = (
        arcs.where(F.col("toxic") >= least)
        .withColumn("odds", odds)
        .where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("clean") <= MAX_CLEAN * F.col("toxic")))
        .orderBy(F.col("toxic").desc(), "clean", "arc")
        .limit(max_lexicon)
        .collect()
    )
    words = {r["arc"][:-1]: r["odds"] for r in kept if r["arc"].endswith(" ")}
    stems = {r["arc"]: r["odds"] for r in kept if not r["arc"].endswith(" ")}
    # A stem whose texts are nearly all those of one longer stem or word has no arc of its own.
    n_of = {r["arc"]: r["toxic"] for r in kept}
    covered = {arc.rstrip(" ")[:-1] for arc, n in n_of.items() if n >= 0.9 * n_of.get(arc.rstrip(" ")[:-1], math.inf)}
    grammar = Grammar(words, {s: w for s, w in stems.items() if s not in covered})
    return _calibrated(_damped(grammar, labelled), labelled)


def _damped(grammar: Grammar, labelled: DataFrame) -> Grammar:
    """The grammar with what negation and report leave of a weight: the share of toxic texts among those whose matches are
    all governed, with BELIEF texts of the given value."""
    shared = labelled.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.governing(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1] for f in found], pa.bool_()), batch.column(1).cast(pa.int64())], names=["n", "r", "toxic"])

    rows = labelled.select("text", "toxic").mapInArrow(run, "n boolean, r boolean, toxic bigint").where("n OR r")
    some = lambda c: [F.coalesce(F.sum(F.when(F.col(c), x)), F.lit(0)) for x in (F.col("toxic"), F.lit(1))]
    t_n, all_n, t_r, all_r = rows.agg(*some("n"), *some("r")).first()
    return Grammar(grammar.words, grammar.stems, negated=(t_n + BELIEF * NEGATED) / (all_n + BELIEF), spoken=(t_r + BELIEF * SPOKEN) / (all_r + BELIEF))


def _calibrated(grammar: Grammar, labelled: DataFrame) -> Grammar:
    """Logistic calibration on the masses of the fitted rows, binned where they were measured."""
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [min(400, round(math.log1p(shared.value.mass(x)) * 50)) if x else 0 for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), batch.column(1).cast(pa.int64())], names=["bin", "toxic"])

    rows = labelled.select("text", "toxic").mapInArrow(run, "bin bigint, toxic bigint").groupBy("bin").agg(F.sum("toxic").alias("one"), F.count("*").alias("all")).collect()
    none = [(r["one"], r["all"]) for r in rows if r["bin"] == 0]
    one0, all0 = none[0] if none else (0, 0)
    x = np.array([r["bin"] / 50 for r in rows if r["bin"]])
    one = np.array([r["one"] for r in rows if r["bin"]], float)
    count = np.array([r["all"] for r in rows if r["bin"]], float)
    slope, offset = 1.0, 0.0
    for _ in range(200 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = count * p * (1 - p) + 1e-6
        g = np.array([np.sum((one - count * p) * x) - 0.5 * (slope - 1.0), np.sum(one - count * p) - 0.5 * offset])
        h = np.array([[np.sum(w * x * x) + 0.5, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.5]])
        step = np.linalg.solve(h, g)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-8:
            break
    grammar.slope, grammar.offset, grammar.floor = float(slope), float(offset), float((one0 + 0.5) / (all0 + 20.0))
    return grammar


def score(documents: DataFrame, grammar: Grammar, text_col: str = "text", with_clauses: bool = False) -> DataFrame:
    """All columns of `documents` but the text, plus score (0 to 1) and, if asked for, the matched clauses with their masses.

    Only the text is looked at. Null and empty texts, and texts without a matched clause, get the share of toxic texts among
    such. Long texts are read whole. Repeated rows get equal scores; own columns replace columns of the same name.
    """
    own = ("score", "clauses")
    keep = [f for f in documents.schema.fields if f.name != text_col and f.name not in own]
    extra = [T.StructField("score", T.DoubleType())]
    if with_clauses:
        extra.append(T.StructField("clauses", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("mass", T.DoubleType())]))))
    schema = T.StructType([*keep, *extra])
    shared = documents.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            more = [pa.array([rules.score(x) for x in texts], pa.float64())]
            if with_clauses:
                kind = pa.list_(pa.struct([("text", pa.string()), ("mass", pa.float64())]))
                more.append(pa.array([[{"text": c, "mass": m} for c, m in rules.clauses(x)] for x in texts], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=schema.names)

    return documents.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text_col}`")).mapInArrow(run, schema)
