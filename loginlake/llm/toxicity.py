"""Toxicity by a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is learned: words, and word beginnings of four to six letters, whose counts of
documents with and without the label differ by more than chance among all terms tried. It forms
a trie. The product of the trie with the Levenshtein automata of its words (one error from five
letters on, two from ten on) is made deterministic step by step as words are read, so a word costs
one look-up per letter, and most leave after a few.

Each hit has a weight (log odds of its term) and a context score from its window: hits between
quotation marks or after a reporting mark count as quotation, the others as abuse. The sums for
exact, misspelled and quoted hits and the share of hits among the words are the inputs of a
logistic regression; labels, language, source and id are not.

Null and empty texts have no hits and get the score of that. Words are those of whole texts.
Repeated rows get equal scores and count as often as they occur, except that a label is joined
by id. Rows without a label do not take part in learning. If no label or only one value was seen,
every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, fold, map_batches, read_table, strings, utf8

WORD = re.compile(r"\w+")
#: Least letters of a word in the lexicon, and of a word beginning.
LETTERS, BEGINNINGS = 4, (4, 5, 6)
#: Terms of the lexicon, the strongest first; it is sent to every task.
MAX_TERMS = 5000
#: Least ratio of the shares of documents with and without the label.
RATIO = 20
WINDOW = 12
#: Words remembered per task, and states of the product automaton.
REMEMBERED, MAX_STATES = 300_000, 50_000
#: Labelled rows that the regression is fitted on, chosen by a hash of the id.
MAX_FIT = 50_000
FEATURES = ("abuse", "misspelled", "quoted", "share")
QUOTES = "\"“”„«»‹›"
PIECES = re.compile(rf"\w+|[{QUOTES}]")


def errors_allowed(word: str) -> int:
    return (len(word) >= 5) + (len(word) >= 10)


class Lexicon:
    """The product of trie and Levenshtein automata over terms (term, whole word, weight)."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[tuple[int, float] | None] = [None]  # errors allowed and weight
        self.beginning: list[float | None] = [None]
        self.allowed = [-1]  # most errors of the words through a node; no word is reached with more
        for term, whole, weight in terms:
            node, errors = 0, errors_allowed(term) if whole else -1
            self.allowed[0] = max(self.allowed[0], errors)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.beginning.append(None)
                    self.allowed.append(-1)
                node = self.children[node][letter]
                self.allowed[node] = max(self.allowed[node], errors)
            if whole:
                self.word[node] = (errors, weight)
            else:
                self.beginning[node] = weight
        self.known: dict[str, tuple[float, bool] | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[dict[int, int]] = []
        self.start = self._state({0: 0})

    def _state(self, places: dict[int, int]) -> int:
        """places: trie nodes with the least errors; missing letters are taken as read."""
        todo = list(places)
        while todo:
            node = todo.pop()
            errors = places[node] + 1
            if errors <= self.allowed[node]:
                for child in self.children[node].values():
                    if errors <= self.allowed[child] and errors < places.get(child, errors + 1):
                        places[child] = errors
                        todo.append(child)
        key = frozenset(places.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(places)
            self.moves.append({})
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= self.allowed[node] and errors < after.get(node, errors + 1):
                after[node] = errors

        for node, errors in self.sets[state].items():
            reach(node, errors + 1)  # a letter too many
            for other, child in self.children[node].items():
                reach(child, errors + (other != letter))
        number = self._state(after) if after else -1
        self.moves[state][letter] = number
        return number

    def find(self, word: str) -> tuple[float, bool] | None:
        """Weight of the terms that a word matches, and whether it is misspelled: the greatest of those
        without an error, or else of those with the fewest."""
        node, best = 0, None
        for letter in word:  # an exact beginning
            node = self.children[node].get(letter)
            if node is None:
                break
            if self.beginning[node] is not None:
                best = (max(self.beginning[node], best[0] if best else 0.0), False)
        if node is not None and self.word[node]:
            best = (max(self.word[node][1], best[0] if best else 0.0), False)
        if best or self.allowed[0] < 1 or len(word) < 4:
            return best
        if len(self.sets) > MAX_STATES:
            self._restart()
        state = self.start
        for letter in word:
            state = self.moves[state].get(letter) if letter in self.moves[state] else self._step(state, letter)
            if state < 0:
                return None
        near = [
            (errors, -self.word[node][1]) for node, errors in self.sets[state].items() if self.word[node] and errors <= self.word[node][0]
        ]
        return (-min(near)[1], True) if near else None

    def features(self, text: str | None) -> tuple[float, ...]:
        if not text:
            return 0.0, 0.0, 0.0, 0.0
        pieces = PIECES.findall(text.lower())
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        known.update([(word, self.find(word)) for word in set(pieces).difference(known)])
        hits = [(at, *hit) for at, hit in enumerate(map(known.__getitem__, pieces)) if hit]
        sums = [0.0, 0.0, 0.0]
        for at, weight, misspelled in hits:
            quoted = quotation(pieces, at)
            sums[2] += weight * quoted
            sums[misspelled] += weight * (1 - quoted)
        return (*np.log1p(sums).tolist(), len(hits) / max(1, len(pieces)))


def quotation(pieces: list[str], at: int) -> float:
    """1 if the window has quotation marks on both sides of a piece, 0.5 on one side, else 0."""
    before = any(x in QUOTES for x in pieces[max(0, at - WINDOW) : at])
    after = any(x in QUOTES for x in pieces[at + 1 : at + 1 + WINDOW])
    return (before + after) / 2


def terms_of(text: str) -> set[tuple[str, bool]]:
    words = {w for w in WORD.findall(text.lower()) if len(w) >= LETTERS}
    return {(w, True) for w in words} | {(w[:k], False) for w in words for k in BEGINNINGS if len(w) > k}


def learn_lexicon(labelled: DataFrame, store: Store) -> list[tuple[str, bool, float]]:
    """Terms of labelled (body: compressed text, label 0 or 1) whose counts differ beyond chance."""
    totals = labelled.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    with_label, without = (int(x or 0) for x in totals)
    if not with_label or not without:
        return []

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        expand = zstandard.ZstdDecompressor().decompress

        def apply(batch):
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = Counter(), Counter()
                for body, label in zip(part.column("body").to_pylist(), part.column("label").to_pylist(), strict=True):
                    found[label].update(terms_of(expand(body).decode()))
                both = list(found[0].keys() | found[1].keys())
                yield {
                    "term": [t for t, _ in both],
                    "whole": [w for _, w in both],
                    "a": [found[1][x] for x in both],
                    "b": [found[0][x] for x in both],
                }

        return apply

    counted = map_batches(labelled, make, "term string, whole boolean, a bigint, b bigint")
    terms = counted.groupBy("term", "whole").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a > 0")
    terms = store.save(terms, "terms")
    share = with_label / (with_label + without)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, all_docs = F.col("a") + F.col("b"), with_label + without
    strength = 2 * (
        part(F.col("a"), n * share)
        + part(F.col("b"), n * (1 - share))
        + part(with_label - F.col("a"), (all_docs - n) * share)
        + part(without - F.col("b"), (all_docs - n) * (1 - share))
    )
    odds = F.log(((F.col("a") + 0.5) / (with_label + 1)) / ((F.col("b") + 0.5) / (without + 1)))
    chance = 2 * np.log(max(2, terms.count()))  # of so many terms one at most gets there by chance
    rows = (
        terms.withColumn("strength", strength)
        .withColumn("odds", odds)
        .where((F.col("strength") > chance) & (F.col("odds") > np.log(RATIO)))
        .orderBy(F.desc("strength"), "term", "whole")
        .limit(MAX_TERMS)
        .select("term", "whole", "odds")
        .collect()
    )
    kept = {r.term for r in rows if not r.whole}
    return [
        tuple(r) for r in rows if r.whole or not any(r.term[:k] in kept for k in BEGINNINGS if k < len(r.term))
    ]  # a beginning that a shorter one covers adds nothing


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> np.ndarray | None:
    """Coefficients of a logistic regression with a ridge, the intercept first."""
    if not len(labels) or labels.min() == labels.max():
        return None
    x = np.column_stack((np.ones(len(rows)), rows))
    weights = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(weights)), x.T @ (labels - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def score(docs: DataFrame, labelled_ids: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, features..., score) of docs; labelled_ids has columns id and label (0 or 1)."""
    spark = docs.sparkSession
    store = Store(spark, "toxicity")
    kind = docs.schema[id_column].dataType.simpleString()
    # labels grow with the documents, so they are not broadcast at any size
    labelled_ids = labelled_ids.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").alias("label")).hint("merge")
    slim = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))

    def compress() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress

        def apply(batch):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield {"id": part.column("id"), "body": [squeeze(x) for x in utf8(part)]}

        return apply

    bodies = map_batches(slim.where("id IS NOT NULL"), compress, f"id {kind}, body binary")
    terms = learn_lexicon(bodies.join(labelled_ids, "id").select("body", F.col("label").cast("int").alias("label")), store)
    shared = spark.sparkContext.broadcast(terms)

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        lexicon = Lexicon(shared.value)

        def apply(batch):
            found = [lexicon.features(x) for x in strings(batch)]
            yield {"id": batch.column("id")} | dict(zip(FEATURES, zip(*found, strict=True), strict=True))

        return apply

    features = store.save(map_batches(slim, make, f"id {kind}, " + ", ".join(f"{x} double" for x in FEATURES)), "features")
    known, place = features.join(labelled_ids, "id"), F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    few = int((1 << 32) * min(1.0, 2 * MAX_FIT / max(1, known.count())))  # so no task sorts more than twice the sample
    sample = known.where(place < few).orderBy(place, "id").limit(MAX_FIT).select(*FEATURES, "label").toPandas()
    weights = fit(sample[list(FEATURES)].to_numpy(float), sample["label"].to_numpy(float))
    if weights is None:
        return features.withColumn("score", F.lit(0.0))
    line = F.lit(float(weights[0]))
    for name, weight in zip(FEATURES, weights[1:].tolist(), strict=True):
        line = line + F.col(name) * weight
    return features.withColumn("score", 1 / (1 + F.exp(-line)))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    found = score(read_table(spark, sf_dir, "documents"), labels.where(fold("id", 5) != 0))
    return found.select(
        F.col("id").alias("doc_id"),
        (fold("id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
