"""Language identification by rank-order profiles.

Each language's profile is the ranking of its most frequent letter n-grams over all training
documents. A document's own most frequent n-grams are ranked in the same way, and its
out-of-place distance to a profile is the sum of the differences of rank, an n-gram that the
profile lacks counting the profile's full length.

Null texts, empty texts and texts without a letter give ``und`` with score 0. Equal counts are
ranked by the n-gram itself, equal distances go to the language first in order of name.
Repeated rows are predicted alike and count as often as they occur in training. Without any
training row every document is ``und``. Whole texts are used, long ones in one pass over an
array. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, map_batches, read_table, strings

#: n-grams of one to three code points; 21 bits hold a code point.
BITS = 21
BLANK = 1
#: Length of a language's profile and of a document's.
PROFILE, DOCUMENT = 400, 300
#: Profiles are sent to every task: this many languages at most, so 800,000 rows of 24 bytes.
MAX_LANGUAGES = 2000
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter; made once per Python worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def gram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of a text's words, each word with a blank before and after."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[codes]
    if not is_letter.any():
        return np.empty(0, np.int64)
    points = np.full(len(codes) + 2, BLANK, np.int64)
    points[1:-1][is_letter] = codes[is_letter]
    points = points[np.concatenate(([True], (points[1:] != BLANK) | (points[:-1] != BLANK)))]
    pairs = points[:-1] << BITS | points[1:]
    triples = pairs[:-1] << BITS | points[2:]
    return np.concatenate((points[points != BLANK], pairs, triples[points[1:-1] != BLANK]))


def counted(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs."""
    if weights is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, weights = codes[order], weights[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    counts = np.diff(np.append(starts, len(codes))) if weights is None else np.add.reduceat(weights, starts)
    return codes[starts], counts


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) summed within each batch; one row for a language, n-gram and batch."""

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            found: dict[str, list] = {}
            for body, name in zip(strings(batch, text), strings(batch, lang), strict=True):
                if body:
                    found.setdefault(name, []).append(counted(gram_codes(body)))
            for name, parts in found.items():
                codes, n = counted(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]))
                if len(codes):
                    yield {"lang": [name] * len(codes), "gram": codes, "n": n}

        return apply

    return map_batches(docs.select(text, lang), make, "lang string, gram bigint, n bigint")


def profiles(training: DataFrame, text: str = "text", lang: str = "lang", length: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): each language's most frequent n-grams over all training rows."""
    totals = count_grams(training, text, lang).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        totals.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= length).select("lang", "gram", "rank")
    )


class Ranks:
    """The profiles as one matrix: the rank of each n-gram in each language."""

    def __init__(self, rows: Sequence[tuple[str, int, int]], length: int):
        self.names = sorted({r[0] for r in rows})
        self.length = length
        column = {name: i for i, name in enumerate(self.names)}
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.table = np.full((len(self.grams) + 1, len(self.names)), -1, np.int32)  # last row: not in any profile
        for name, gram, rank in rows:
            self.table[np.searchsorted(self.grams, gram), column[name]] = rank - 1

    def predict(self, text: str | None, top: int) -> tuple[str, float]:
        codes = gram_codes(text) if text and self.names else np.empty(0, np.int64)
        if not len(codes):
            return UNDETERMINED, 0.0
        grams, n = counted(codes)
        if len(grams) > top:  # all that are as frequent as the last one kept, before ties are ordered
            least = np.partition(n, len(n) - top)[len(n) - top]
            grams, n = grams[n >= least], n[n >= least]
        grams = grams[np.lexsort((grams, -n))][:top]
        at = np.searchsorted(self.grams, grams)
        at = np.where(self.grams[np.minimum(at, len(self.grams) - 1)] == grams, at, len(self.grams))
        ranks = self.table[at]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(grams))[:, None]), self.length).sum(axis=0)
        best = int(np.argmin(apart))
        if len(self.names) == 1:
            return self.names[0], float(np.clip(1 - apart[0] / (len(grams) * self.length), 0, 1))
        second = float(np.partition(apart, 1)[1])
        return self.names[best], float(np.clip((second - apart[best]) / second, 0, 1)) if second else 0.0


def predict(
    docs: DataFrame,
    found: DataFrame,
    text: str = "text",
    length: int = PROFILE,
    top: int = DOCUMENT,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """Adds the predicted language and its score to the columns of docs, replacing columns of
    these names. The score is the lead of the nearest profile over the next, as a share of the
    next one's distance."""
    rows = [tuple(r) for r in found.limit(MAX_LANGUAGES * length + 1).collect()]
    if len(rows) > MAX_LANGUAGES * length:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    kept = [c for c in docs.columns if c not in names]

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        ranks = Ranks(shared.value, length)

        def apply(batch):
            out = [ranks.predict(t, top) for t in strings(batch, text)]
            yield {c: batch.column(c) for c in kept} | {
                names[0]: [x[0] for x in out],
                names[1]: [x[1] for x in out],
            }

        return apply

    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double")
    return map_batches(docs.select(*kept), make, schema)


def training_rows(docs: DataFrame, folds: int = 4, held: int = 2) -> Column:
    return (fold("doc_id", folds) != held) & F.col("lang").isNotNull()


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = profiles(docs.where(training_rows(docs)))
    slim = docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    return predict(slim, found).select("doc_id", "held_out", "lang_pred", "score")
