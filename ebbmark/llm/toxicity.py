"""Toxicity: a weighted finite-state grammar of insult, threat, target, negation and reported speech."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.llm.common import map_texts, whole_texts

# Closed word classes of the grammar, in the four languages of the texts.
THREAT = "kill hurt destroy beat shoot burn töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGET = "you your yours he she they them du dich dir ihr euch tu toi te vous ils tú ti te usted ellos".split()
NEGATION = "not no never neither nicht kein keine nie pas jamais aucun nunca ningún tampoco".split()
REPORT = "said says wrote called quoted reported claimed sagte schrieb nannte dit écrit disait dijo escribió llamó".split()

#: The lexicon and the weights are learnt from at most so many labelled documents.
FIT_DOCS = 8_000
#: Shortest and longest stems of the lexicon, and the least toxic documents of an entry.
STEM, LONGEST_STEM, SUPPORT = 4, 8, 6
#: Least log odds of an entry.
LEAST_ODDS = 2.0
THRESHOLD = 0.3

WORD = re.compile(r"[^\W\d_]+")
#: A clause ends at closing punctuation, a semicolon, colon or line break.
CLAUSE = re.compile(r"[.!?;:\n]+")

INSULT, THREATEN, AIM, DENY, TELL, OTHER = range(6)
KINDS = 6


def transducers() -> list[tuple[int, dict[tuple[int, int], int], dict[tuple[int, int], float]]]:
    """States, moves ``(state, kind) -> state`` and factors ``(state, kind) -> factor``; elsewhere stay, factor 1.

    Each reads a clause's words by kind and changes the weight of the insults and threats in it.
    """
    target = (2, {(0, AIM): 1}, {(1, INSULT): 1.5, (1, THREATEN): 2.0, (0, THREATEN): 0.2})
    # a negation reaches over the next three words
    deny = (4, {(s, DENY): 3 for s in range(4)} | {(s, k): s - 1 for s in (1, 2, 3) for k in range(KINDS) if k != DENY}, {(s, INSULT): 0.3 for s in (1, 2, 3)} | {(s, THREATEN): 0.3 for s in (1, 2, 3)})
    tell = (2, {(0, TELL): 1}, {(1, INSULT): 0.6, (1, THREATEN): 0.6})
    # the second insult of a clause weighs more than the first
    pile = (2, {(0, INSULT): 1}, {(1, INSULT): 1.2})
    return [target, deny, tell, pile]


def compose(parts) -> tuple[list[list[int]], list[list[float]]]:
    """The product of the transducers, as tables by state and kind: next state, product of the factors."""
    states, index, moves, factors = [(0,) * len(parts)], {(0,) * len(parts): 0}, [], []
    for state in states:  # grows while states are found
        moves.append([])
        factors.append([])
        for kind in range(KINDS):
            to = tuple(m.get((s, kind), s) for s, (_, m, _) in zip(state, parts, strict=True))
            if to not in index:
                index[to] = len(states)
                states.append(to)
            moves[-1].append(index[to])
            factors[-1].append(math.prod(f.get((s, kind), 1.0) for s, (_, _, f) in zip(state, parts, strict=True)))
    return moves, factors


@dataclass
class Grammar:
    """Insult words and stems with their weights, composed with the fixed transducers."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...] = (-2.0, 1.0, 0.5, 0.0, 0.0)

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "weights": self.weights}

    @cached_property
    def tables(self):
        return compose(transducers())

    @cached_property
    def _known(self) -> dict[str, tuple[int, float]]:
        return {}

    def read(self, word: str) -> tuple[int, float]:
        """Kind and weight of a lower-case word: whole words first, then the longest stem that it begins with."""
        found = self._known.get(word)
        if found is None:
            if len(self._known) > 300_000:
                self._known.clear()
            found = self._known[word] = self._read(word)
        return found

    def _read(self, word: str) -> tuple[int, float]:
        for kind, words in ((THREATEN, THREAT), (AIM, TARGET), (DENY, NEGATION), (TELL, REPORT)):
            if word in words:
                return kind, 2.0
        if word in self.words:
            return INSULT, self.words[word]
        for size in range(min(len(word), LONGEST_STEM), STEM - 1, -1):
            if word[:size] in self.stems:
                return INSULT, self.stems[word[:size]]
        return OTHER, 0.0

    def clauses(self, text: str) -> list[float]:
        """The weight of each clause that holds an insult or a threat."""
        moves, factors = self.tables
        read, known, found = self.read, self._known, []
        for clause in CLAUSE.split(text.lower()):
            words = WORD.findall(clause)
            kinds = [known.get(w) or read(w) for w in words]
            if not any(w for _, w in kinds):
                continue
            state, total = 0, 0.0
            for kind, weight in kinds:
                if kind <= THREATEN:
                    total += weight * factors[state][kind]
                state = moves[state][kind]
            if total:
                found.append(total)
        return found

    def features(self, text: str) -> list[float]:
        found = self.clauses(text)
        total = sum(found)
        return [1.0, max(found, default=0.0), math.log1p(total), math.log1p(len(found)), 100 * total / (len(text) + 200)]

    def score(self, text: str) -> tuple[float, int]:
        """From 0 to 1, and the number of matched clauses."""
        x = self.features(text)
        z = sum(w * v for w, v in zip(self.weights, x, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), round(math.expm1(x[3]))


def forms(text: str) -> set[str]:
    """Words of a text, and their stems marked by a closing hyphen."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in range(STEM, min(len(w), LONGEST_STEM + 1))}


def held_out(column):
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(4)) == 2


def fit_grammar(docs: DataFrame, labels: DataFrame, *, most_docs: int = FIT_DOCS) -> Grammar:
    """Learn the insult lexicon and the weights from labelled documents that are not held out.

    The sample is bounded and fixed by the hashes of the ids. An entry is a word or stem that many toxic and
    hardly any other documents hold; a stem is kept if it is as sure as its longer forms. Without toxic or
    without other documents the lexicon is empty and every text scores alike.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    texts = whole_texts(docs).join(F.broadcast(sample), "doc_id").select("toxic", "text")

    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if set(sizes) != {0, 1}:
        return Grammar({}, {})

    def count(c: list[list]) -> list[list]:
        found = (Counter(), Counter())
        for toxic, text in zip(*c, strict=True):
            found[toxic].update(forms(text))
        every = list(found[0] | found[1])
        return [every, *([n[w] for w in every] for n in found)]

    counted = map_texts(texts, count, "form string, good long, bad long").groupBy("form").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.1) / (sizes[1] + 0.2)) - F.log((F.col("good") + 0.1) / (sizes[0] + 0.2))
    # only entries that speak for toxicity reach the driver
    entries = counted.where(F.col("bad") >= SUPPORT).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).collect()
    sure = {r.form: r.odds for r in entries}
    rare = {r.form for r in entries if 20 * r.good <= r.bad}
    stems: dict[str, float] = {}
    for w in sorted((w[:-1] for w in sure if w.endswith("-")), key=lambda w: (len(w), w)):
        if w + "-" in rare and not any(w[:k] in stems for k in range(STEM, len(w))):
            stems[w] = sure[w + "-"]
    words = {w: o for w, o in sure.items() if not w.endswith("-")}
    grammar = Grammar(words, stems)
    measured = map_texts(texts, lambda c: [c[0], [grammar.features(t) for t in c[1]]], "toxic int, x array<double>")
    got = sorted((r.toxic, *r.x) for r in measured.toLocalIterator())
    return Grammar(words, stems, logistic(np.array([g[1:] for g in got]), np.array([g[0] for g in got])))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small quadratic penalty."""
    w, penalty = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1]) * len(x) / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty @ w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
    return tuple(w.tolist())


def toxicity(docs: DataFrame, grammar: Grammar, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_clauses`` per row, from the whole text alone; no shuffle.

    Null and empty texts have no clause and get the score of a text without matches; repeated rows each get
    theirs; an empty table gives none; a null id is passed on.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(c: list[list]) -> list[list]:
        found = [grammar.score(t) for t in c[1]]
        return [c[0], [score for score, _ in found], [n for _, n in found]]

    return map_texts(whole_texts(docs, id_col, text_col), rows, f"doc_id {kind}, score double, n_clauses long")


def op5(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs, fit_grammar(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
