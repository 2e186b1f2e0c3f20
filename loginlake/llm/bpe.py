"""Byte-level BPE by recursive DuckDB queries inside each partition.

A task takes the distinct words (pattern matches) of its texts and writes them as rows of
(word, position, token), one per byte. A recursive query joins neighbouring tokens with the
merge table, contracts each word's leftmost pair of minimum rank, and goes on with the words
that still changed until none does. A join with the vocabulary's byte strings, ordered by word and
position, decodes. Words are put together again by their order in each text, so ids and decoded
bytes are those of the whole text.

Long words (of 64 bytes or more) take all occurrences of their minimum rank in one step, non-overlapping
from the left. That gives the same ids where the new token is part of no merge of lower rank;
for other tokens only the leftmost pair is taken.

Null and empty texts give no ids and empty bytes. Repeated texts give equal rows. Long texts are
taken whole; a task holds the words of a few MB of text, or of one longer text, and a bounded
memory of words met before. Only the text column is read; output columns replace columns of the
same name.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Callable, Iterable, Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import map_batches, read_table, strings

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text per step, words per query, bytes per query of long words, steps per such query.
STEP_BYTES, QUERY_WORDS, LONG_BYTES, LONG_STEPS = 2_000_000, 20_000, 1_000_000, 16
LONG = 64
#: Words remembered per Python worker: two generations of this many.
REMEMBERED = 400_000

#: A cell is a position and a token as one number, position first, so cells sort by position. Each keeps the
#: cell after it and what both merge to; a step looks up only the two pairs that the new token is part of:
#: the absorbed cell's row becomes the new token's, the row of the pair's first token goes.
_SHORT_SQL = """
WITH RECURSIVE steps(w, cell, next_cell, merged, step) AS (
  SELECT w, cell, next_cell, m.merged, 0::UTINYINT
  FROM (SELECT w, cell, lead(cell) OVER (PARTITION BY w ORDER BY cell) AS next_cell
        FROM (SELECT w::INTEGER AS w, (pos * 65536 + tok)::INTEGER AS cell FROM words))
  LEFT JOIN short_merges m ON m.pair = (cell & 65535)::BIGINT * 65536 + (next_cell & 65535)
  UNION ALL
  (WITH chosen AS (
     SELECT w, min(place) AS place, arg_min(next_cell, place) AS absorbed
     FROM (SELECT w, next_cell, merged * 64 + (cell >> 16) AS place FROM steps WHERE merged IS NOT NULL) GROUP BY w),
   moved AS (
     SELECT w, merged, step, CASE WHEN cell = absorbed THEN new_cell ELSE cell END AS cell,
            CASE WHEN next_cell >> 16 = new_cell >> 16 THEN new_cell ELSE next_cell END AS next_cell,
            cell = absorbed OR coalesce(next_cell >> 16 = new_cell >> 16, false) AS changed
     FROM steps JOIN (SELECT w, absorbed, (place & 63) * 65536 + (place >> 6) AS new_cell FROM chosen) USING (w)
     WHERE cell >> 16 <> new_cell >> 16)
   SELECT w, cell, next_cell, CASE WHEN changed THEN m.merged ELSE p.merged END, step + 1::UTINYINT
   FROM moved p LEFT JOIN short_merges m
     ON m.pair = CASE WHEN changed THEN (cell & 65535)::BIGINT * 65536 + (next_cell & 65535) END)
)
SELECT w, cell >> 16 AS pos, cell & 65535 AS tok
FROM steps JOIN (SELECT w, max(step) AS step FROM steps GROUP BY w) USING (w, step)
"""

_LONG_SQL = """
WITH RECURSIVE steps(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM words
  UNION ALL
  SELECT w, pos, CASE WHEN taken THEN merged ELSE tok END, step + 1
  FROM (
    SELECT *, lag(taken) OVER (PARTITION BY w ORDER BY pos) AS taken_before
    FROM (
      SELECT *, least AND CASE WHEN lone THEN pos = min(pos) FILTER (WHERE least) OVER (PARTITION BY w)
                               ELSE row_number() OVER (PARTITION BY w, least, run ORDER BY pos) % 2 = 1 END AS taken
      FROM (
        SELECT *, place - sum(CASE WHEN least THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY pos) AS run
        FROM (
          SELECT p.*, m.merged, m.lone, coalesce(m.merged = min(m.merged) OVER (PARTITION BY w), false) AS least,
                 min(m.merged) OVER (PARTITION BY w) AS least_rank
          FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS next_tok,
                       row_number() OVER (PARTITION BY w ORDER BY pos) AS place FROM steps) p
          LEFT JOIN merges m ON m.pair = p.tok * 4294967296 + p.next_tok)
        WHERE least_rank IS NOT NULL)))
  WHERE taken_before IS NOT TRUE AND step < {steps}
)
SELECT w, pos, tok FROM steps JOIN (SELECT w, max(step) AS step FROM steps GROUP BY w) USING (w, step)
"""

_FINISH_SQL = "SELECT w, tok, bytes FROM final JOIN vocabulary ON tok = id ORDER BY w, pos"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_rows(ranks: dict[bytes, int]) -> pa.Table:
    """(pair, merged, lone): every pair of tokens whose bytes make a token. lone: the new token
    is part of a merge of lower rank, so other places must wait for it."""
    rows = [
        (ranks[token[:k]], ranks[token[k:]], rank)
        for token, rank in ranks.items()
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    first, second, merged = np.array(rows, np.int64).reshape(-1, 3).T
    least = np.full(max(ranks.values()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, first, merged)
    np.minimum.at(least, second, merged)
    return pa.table({"pair": first << 32 | second, "merged": merged, "lone": least[merged] < merged})


class Encoder:
    """Encodes sets of words; the tables live in an in-memory database of the Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.db = duckdb.connect(config={"threads": 1})
        self.db.sql("SET memory_limit = '1GB'")
        merges = merge_rows(ranks)  # noqa: F841  read by name
        vocabulary = pa.table({"id": list(ranks.values()), "bytes": list(ranks)})  # noqa: F841
        self.db.sql("CREATE TABLE merges AS SELECT * FROM merges")
        # cells hold tokens below 65,536; a larger vocabulary takes the other query for all words
        self.short = LONG if max(ranks.values()) < 1 << 16 else 0
        self.db.sql(
            "CREATE TABLE short_merges AS SELECT (pair >> 32) * 65536 + (pair & 4294967295) AS pair,"
            " merged::INTEGER AS merged FROM merges"
        )
        self.db.sql("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def _rows(self, words: list[bytes]) -> pa.Table:
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        return pa.table(
            {
                "w": np.repeat(np.arange(len(words)), lengths),
                "pos": np.arange(ends[-1]) - np.repeat(ends - lengths, lengths),
                "tok": self.byte_ids[np.frombuffer(b"".join(words), np.uint8)],
            }
        )

    def _solve(self, words: list[bytes], long: bool) -> list[tuple[bytes, bytes]]:
        """Ids (as 32-bit integers) and decoded bytes of each word."""
        final = self._rows(words)
        self.db.register("words", final)
        if not long:
            final = self.db.sql(_SHORT_SQL).to_arrow_table()
        while long:  # a bounded number of steps at a time, as a recursive query keeps all of them
            before, final = final, self.db.sql(_LONG_SQL.format(steps=LONG_STEPS)).to_arrow_table()
            self.db.register("words", final)
            long = len(final) < len(before)
        self.db.register("final", final)
        # the rows of a word follow each other, so its ids and its bytes are one slice of them all
        done = self.db.sql(_FINISH_SQL).to_arrow_table()
        rows = np.searchsorted(done.column("w").to_numpy(), np.arange(len(words) + 1))
        values = done.column("tok").to_numpy().astype(np.int32).tobytes()
        ends = done.column("bytes").combine_chunks().cast(pa.large_binary()).buffers()
        cuts, marks = (rows * 4).tolist(), np.frombuffer(ends[1], np.int64)[rows].tolist()
        joined = ends[2].to_pybytes() if ends[2] else b""
        return [
            (values[a:b], joined[c:d]) for a, b, c, d in zip(cuts, cuts[1:], marks, marks[1:], strict=False)
        ]

    def words(self, wanted: set[str]) -> dict[str, tuple[bytes, bytes]]:
        found, new, long = dict(zip(wanted, map(self.young.get, wanted), strict=True)), [], []
        for word in [w for w, known in found.items() if known is None]:
            if known := self.old.get(word):
                found[word] = self.young[word] = known
            elif len(body := word.encode()) < self.short:
                new.append((word, body))
            else:
                long.append((word, body))
        for at in range(0, len(new), QUERY_WORDS):
            part = new[at : at + QUERY_WORDS]
            solved = dict(zip((w for w, _ in part), self._solve([b for _, b in part], False), strict=True))
            found |= solved
            self.young |= solved
        for part in _by_bytes(long, LONG_BYTES, lambda x: len(x[1])):
            found |= zip((w for w, _ in part), self._solve([b for _, b in part], True), strict=True)
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return found


def _by_bytes(items: Iterable, most: int, size: Callable) -> Iterator[list]:
    part, total = [], 0
    for item in items:
        if part and total + size(item) > most:
            yield part
            part, total = [], 0
        part.append(item)
        total += size(item)
    if part:
        yield part


_encoders: dict[int, Encoder] = {}


def encode(docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds ids (array<int>) and decoded (binary) to docs. path is a file of ranks, which the
    driver reads and sends out: its size is that of a vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        key = hash(frozenset(shared.value.items()))
        if key not in _encoders:  # tasks of one Python worker share it
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        encoder, split = _encoders[key], regex.compile(pattern)

        def apply(batch):
            texts = strings(batch, text)
            at = 0
            gc.disable()  # words and pairs form no cycles, and there are millions of them
            for part in _by_bytes(texts, STEP_BYTES, lambda x: len(x or "")):
                words = [split.findall(x) if x else [] for x in part]
                solved = encoder.words(set().union(*words))
                ids, decoded = [], []
                for own in words:
                    pairs = list(map(solved.__getitem__, own))
                    ids.append(b"".join([x for x, _ in pairs]))
                    decoded.append(b"".join([x for _, x in pairs]))
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                rows = batch.slice(at, len(part))
                at += len(part)
                yield {c: rows.column(c) for c in kept} | {
                    "ids": pa.ListArray.from_arrays(pa.array(offsets), values),
                    "decoded": decoded,
                }
            gc.enable()

        return apply

    schema = docs.select(*kept).schema.add("ids", ArrayType(IntegerType())).add("decoded", "binary")
    return map_batches(docs.select(*kept), make, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path(VOCABULARY)).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
