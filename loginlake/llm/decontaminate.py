"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

The index is of the test items; every passage of every document is a query of all its words.
Impacts are divided by the item's threshold (a share of the score that the item has as its own
query), so an item is retrieved at a score of 1 or more. As in block-max WAND, postings are only
read where an upper bound reaches the threshold: first the sum of the terms' greatest impacts
must reach it, then for a block of items the sum of the terms' greatest impacts in the block.
Bounds never lie below the score, so all items above the threshold are retrieved.

Passages are windows of two steps, one step apart; a step is a quarter longer than the longest
item, so an item's copy lies wholly in some window. A retrieved item counts as found when the
window has 0.8 of the five-word shingles of its question and 0.8 of the words of its answer. The
answer is the last sentence, or the last quarter of the words if there is one sentence only; a
question of under five words is one shingle.

Null and empty texts have no matches. Items that are null or have under five words are left out,
as nothing could be verified. Equal items are all reported; an item found in several windows is
reported once, with its best window. Repeated rows give equal rows. Words are taken from whole
texts. Document frequencies, number, mean and greatest length of the items are counted once over all of
them. Items are sent to the tasks in shards of a bounded size; with several, each shard is a pass of its own
over the documents, whose matches so far are stored in between, so a task holds one shard's index at a time
and the number of shards changes no result. Matches of a document are in order of item and place. Only text
columns are read; an output column replaces one of the same name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from .common import Store, map_batches, read_table, strings

K1, B = 1.2, 0.75
SHINGLE, OVERLAP, THRESHOLD = 5, 0.8, 0.6
BLOCK = 4
#: Twice the characters of items in one shard; its index is a small multiple of that.
SHARD_CHARS = 16_000_000
WORDS = re.compile(r"\w+")


def split_words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    cuts = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.rstrip())]
    for cut in reversed(cuts):
        question, answer = split_words(text[:cut]), split_words(text[cut:])
        if answer and len(question) >= SHINGLE:
            return question, answer
    words = split_words(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def shingles(words: Sequence[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    if not words:
        return set()
    size = min(size, len(words))
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _gather(starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Places of all entries of the terms' lists, the lists being one after the other."""
    lengths = starts[terms + 1] - starts[terms]
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[terms] - (ends - lengths), lengths)


@dataclass
class Item:
    id: object
    question: set
    answer: set


@dataclass
class Corpus:
    """What scores need to know of all items: their number, words, greatest length, and the items with a word."""

    items: int
    words: int
    longest: int
    df: dict[str, int]


class Index:
    """Postings by term, block maxima by term, and the greatest impact of each term."""

    def __init__(
        self, rows: Sequence[tuple[object, str]], threshold: float = THRESHOLD, block: int = BLOCK, corpus: Corpus | None = None
    ):
        parsed = [(key, text, split_words(text)) for key, text in rows if text]
        parsed = sorted((x for x in parsed if len(x[2]) >= SHINGLE), key=lambda x: len(x[2]))  # alike in a block
        self.items, self.block = [], block
        for key, text, _ in parsed:
            question, answer = question_and_answer(text)
            self.items.append(Item(key, shingles(question), set(answer)))
        self.terms: dict[str, int] = {}
        counts = [Counter(words) for _, _, words in parsed]
        if corpus is None:  # these are all items
            lengths = [len(words) for _, _, words in parsed]
            corpus = Corpus(len(parsed), sum(lengths), max(lengths, default=0), Counter(chain.from_iterable(counts)))
        self.step = corpus.longest * 5 // 4 + 1
        df, total, average = corpus.df, corpus.items, corpus.words / max(1, corpus.items)
        rows_ = []
        for number, ((_, _, words), count) in enumerate(zip(parsed, counts, strict=True)):
            norm = K1 * (1 - B + B * len(words) / average)
            impacts = {
                w: np.log1p((total - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in count.items()
            }
            least = threshold * sum(impacts.values())
            rows_ += [(self.terms.setdefault(w, len(self.terms)), number, x / least) for w, x in impacts.items()]
        rows_.sort()
        term, self.item, self.impact = (np.array([r[k] for r in rows_], t) for k, t in ((0, int), (1, int), (2, float)))
        self.postings = np.searchsorted(term, np.arange(len(self.terms) + 1))
        group = term * (len(parsed) // block + 1) + self.item // block
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, int)
        self.blocks = self.item[first] // block
        self.block_impact = np.maximum.reduceat(self.impact, first) if len(first) else np.empty(0)
        self.block_lists = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        self.greatest = np.maximum.reduceat(self.impact, self.postings[:-1]) if len(term) else np.empty(0)

    def retrieve(self, terms: np.ndarray, open_blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of the open blocks with a score of 1 or more for a query of distinct terms, and
        the scores; only these blocks' postings count."""
        at = _gather(self.postings, terms)
        at = at[open_blocks[self.item[at] // self.block]]
        scores = np.bincount(self.item[at], self.impact[at])
        found = np.flatnonzero(scores >= 1 - 1e-9)
        return found, scores[found]

    def open_blocks(self, step: np.ndarray, term: np.ndarray, steps: int) -> np.ndarray:
        """(window, block): whether the block's bound reaches the threshold. Windows are two
        steps; only those that the terms' own maxima let pass are looked up."""
        sums = np.bincount(step, self.greatest[term], steps + 1)
        likely = sums[:-1] + sums[1:] >= 1 - 1e-9
        needed = np.concatenate((likely, [False])) | np.concatenate(([False], likely))
        step, term = step[needed[step]], term[needed[step]]
        at = _gather(self.block_lists, term)
        width = len(self.items) // self.block + 1
        cells = np.repeat(step, self.block_lists[term + 1] - self.block_lists[term]) * width + self.blocks[at]
        bounds = np.bincount(cells, self.block_impact[at], (steps + 1) * width).reshape(-1, width)
        return (bounds[:-1] + bounds[1:] >= 1 - 1e-9) & likely[:, None]

    def search(self, text: str | None) -> list[dict]:
        """Items found in a text, each with its best window (in words)."""
        if not text or not self.items:
            return []
        words = split_words(text)
        known = np.fromiter((self.terms.get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(known >= 0)
        if not len(at):
            return []
        n = len(self.terms)
        pairs = np.unique(at // self.step * n + known[at])  # distinct terms of each step
        step, term = pairs // n, pairs % n
        steps = len(words) // self.step + 1
        open_blocks = self.open_blocks(step, term, steps)
        bounds = np.searchsorted(step, np.arange(steps + 2))
        best: dict[int, dict] = {}
        for k in np.flatnonzero(open_blocks.any(axis=1)):
            window = None
            query = np.unique(term[bounds[k] : bounds[k + 2]])
            for number, score in zip(*self.retrieve(query, open_blocks[k]), strict=True):
                if window is None:
                    window = words[k * self.step : (k + 2) * self.step]
                    seen = {size: shingles(window, size) for size in range(1, SHINGLE + 1)}
                item = self.items[number]
                size = len(next(iter(item.question)))
                question = len(item.question & seen[size]) / len(item.question)
                answer = sum((w,) in seen[1] for w in item.answer) / len(item.answer)
                if question >= OVERLAP and answer >= OVERLAP and score > best.get(number, {"score": 0})["score"]:
                    best[number] = {
                        "item_id": item.id,
                        "score": float(score),
                        "question_overlap": question,
                        "answer_overlap": answer,
                        "first_word": int(k) * self.step,
                        "end_word": min(len(words), (int(k) + 2) * self.step),
                    }
        return [best[number] for number in sorted(best)]


def _shards(items: DataFrame, id_column: str, text: str, store: Store) -> tuple[DataFrame, DataFrame, Corpus, int]:
    """Stored items (id, text, shard), stored (shard, word, df), the corpus without its words, and the number of shards."""

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            words = [split_words(x) for x in strings(batch)]
            kept = pa.array([k for k, x in enumerate(words) if len(x) >= SHINGLE], pa.int64())
            words = [words[k] for k in kept.to_pylist()]
            yield {
                "id": batch.column("id").take(kept),
                "text": batch.column("text").take(kept),
                "n": [len(x) for x in words],
                "words": [sorted(set(x)) for x in words],
            }

        return apply

    slim = items.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    schema = StructType().add("id", items.schema[id_column].dataType).add("text", "string").add("n", "long").add("words", ArrayType(StringType()))
    parsed = store.save(map_batches(slim, make, schema), "items")
    count, words, longest, chars = parsed.agg(F.count("*"), F.sum("n"), F.max("n"), F.sum(F.length("text"))).first()
    shards = 1 + (chars or 0) * 2 // SHARD_CHARS
    parsed = parsed.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    terms = parsed.select("shard", F.explode("words").alias("word")).groupBy("shard", "word").agg(F.count("*").alias("n"))
    df = terms.groupBy("word").agg(F.sum("n").alias("df"))
    terms = store.save(terms.select("shard", "word").join(df, "word"), "terms")
    return parsed.select("id", "text", "shard"), terms, Corpus(count, words or 0, longest or 0, {}), shards


def add_matches(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    name: str = "matches",
) -> DataFrame:
    """docs with one more column (replacing one of its name): the items found in each document."""
    kept = [c for c in docs.columns if c != name]
    one = (
        StructType()
        .add("item_id", items.schema[item_id].dataType)
        .add("score", DoubleType())
        .add("question_overlap", DoubleType())
        .add("answer_overlap", DoubleType())
        .add("first_word", LongType())
        .add("end_word", LongType())
    )
    out, schema = docs.select(*kept), docs.select(*kept).schema.add(name, ArrayType(one))
    store, before = Store(docs.sparkSession, "benchmark"), None
    rows, terms, corpus, shards = _shards(items, item_id, item_text, store)
    for number in range(shards):
        here = F.col("shard") == number
        df = {r.word: r.df for r in terms.where(here).select("word", "df").collect()}
        found = [tuple(r) for r in rows.where(here).select("id", "text").collect()]
        shared = docs.sparkSession.sparkContext.broadcast((found, Corpus(corpus.items, corpus.words, corpus.longest, df)))

        def make(shared=shared, number=number) -> Callable[[pa.RecordBatch], Iterable[dict]]:
            own, known = shared.value
            index = Index(own, corpus=known)

            def apply(batch):
                found = [index.search(x) for x in strings(batch, text)]
                if number:
                    found = [a + b for a, b in zip(batch.column(name).to_pylist(), found, strict=True)]
                for x in found:
                    x.sort(key=lambda m: (str(m["item_id"]), m["first_word"]))
                yield {c: batch.column(c) for c in kept} | {name: found}

            return apply

        out = map_batches(out, make, schema)
        if number < shards - 1:  # the next pass reads what this one found
            stored = store.save(out, f"matches-{number}")
            if before is not None:
                store.drop(before)
            out = before = stored
            shared.destroy()
    return out


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = add_matches(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("found")).select("doc_id", "found.*")
