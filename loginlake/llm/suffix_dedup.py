"""Repeated byte strings of a fixed length, by a depth-limited most-significant-digit sort.

The suffixes of all texts are ordered only as deep as the threshold (200 bytes), so equal groups
are exactly the repeated windows. Digits are strings of bytes that are a function of the window's
content, and a pass sorts by one digit:

1. the anchor: of the window's 32-byte strings the one with the least hash (the leftmost, if
   equal), together with its place in the window. Neighbouring windows share anchors, so all
   windows of an anchor (85 on average) are one row, and rows whose anchor occurs once leave.
2. the whole stretch that an anchor's windows span: rows with equal stretches are repeated in all
   their windows. One row of each different stretch goes on.
3. per block of 16 windows, first the 185 bytes that all of them share, then the block's stretch.
4. single windows of the blocks in which different stretches are left.

A row that is alone in its group leaves, as in any radix sort that stops at groups of one. Only
rows move between tasks, with hashes of 64 bits per digit; groups are counted, never gathered,
and pre-aggregated before each shuffle. The texts move twice, compressed, to give the bytes of
the rows of passes 3 and 4 and to cut out what is repeated.

Null texts are empty. Texts shorter than the length have no window and keep all bytes. Repeated
rows are each other's repetition. A row is known by its id and a hash of its text, so null ids
are allowed. Long texts are passed in pieces of a million anchor places, with rows that do not
differ from those of the whole. Other columns are not read, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, map_batches, read_table, utf8

LENGTH, ANCHOR, BLOCK = 200, 32, 16
PIECE_BITS = 20
PLACE = np.uint64((1 << PIECE_BITS) - 1)
#: Windows of a text that are looked at together.
PIECE = (1 << PIECE_BITS) - 1024

_random = np.random.default_rng(2024)
_BYTES = _random.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = int(_random.integers(0, 2**63, dtype=np.uint64)) * 2 + 1 & (2**64 - 1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's factor and of its inverse modulo 2**64; once per Python worker."""
    global _powers
    if _powers is None:
        both = []
        for factor in (_STEP, pow(_STEP, -1, 2**64)):
            factors = np.full((1 << PIECE_BITS) + 1, factor, np.uint64)
            factors[0] = 1
            both.append(np.multiply.accumulate(factors))
        _powers = both[0], both[1]
    return _powers


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


class Hashes:
    """Hashes of any substring of a piece, from one pass over its bytes."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers()
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length))


def anchors(raw: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[dict[str, np.ndarray]]:
    """Rows of pass 1 and 2, piece by piece: windows lo to hi share the anchor at place p.

    A piece gives the anchors that lie in it and looks at all windows that these may have, also
    those that begin before the piece, so an anchor is one row wherever the pieces end."""
    before = length - anchor
    for at in range(0, len(raw) - anchor + 1 if len(raw) >= length else 0, PIECE):
        base = max(0, at - before)
        piece = raw[base : at + PIECE + length - 1]
        hashes = Hashes(piece)
        key = hashes.every(anchor)
        least = (key & ~PLACE) | np.arange(len(key), dtype=np.uint64)
        width, size = length - anchor + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        place = (least & PLACE).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        hi = np.append(starts[1:], len(place)) - 1
        p = place[starts]
        own = (p + base >= at) & (p + base < at + PIECE)
        starts, hi, p = starts[own], hi[own], p[own]
        wide = hashes.of(starts, hi + length) + (p - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        yield {
            "key": key[p],
            "wide": mixed(wide + (hi - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)),
            "lo": starts + base,
            "hi": hi + base,
            "p": p + base,
        }


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _identified(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))


def _anchor_rows(texts: DataFrame, kind: str) -> DataFrame:
    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            rows, parts, held = [], [], 0
            for number, body in enumerate(utf8(batch)):
                for part in anchors(np.frombuffer(body, np.uint8)):
                    rows.append(np.full(len(part["p"]), number))
                    parts.append(part)
                    held += len(part["p"])
                    if held > 100_000:
                        yield joined(batch, rows, parts)
                        rows, parts, held = [], [], 0
            if parts:
                yield joined(batch, rows, parts)

        def joined(batch, rows, parts):
            of = pa.array(np.concatenate(rows))
            columns = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
            return {
                "key": _signed(columns["key"]),
                "wide": _signed(columns["wide"]),
                "id": batch.column("id").take(of),
                "h": batch.column("h").take(of),
                **{k: columns[k].astype(np.int32) for k in ("lo", "hi", "p")},
            }

        return apply

    return map_batches(texts, make, f"key bigint, wide bigint, id {kind}, h bigint, lo int, hi int, p int")


def _compressed(texts: DataFrame, kind: str) -> DataFrame:
    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress

        def apply(batch):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield {"id": part.column("id"), "h": part.column("h"), "body": [squeeze(x) for x in utf8(part)]}

        return apply

    return map_batches(texts, make, f"id {kind}, h bigint, body binary")


def sorted_pass(rows: DataFrame, group: str, member: str, keep: list[str], store: Store) -> tuple[DataFrame, DataFrame]:
    """One pass: rows (group, member, n, keep...) are grouped by a digit and then by the next.

    First result: the rows alone in nothing yet (n = 1) whose member class has others, so they
    are repeated. Second: one row of each class, n at most 2, where a group has several."""
    # stored, so that both sides of the joins come from shuffles whose hot keys can be split
    classes = store.save(
        rows.groupBy(group, member).agg(F.sum("n").alias("total"), *[F.first(c).alias(c) for c in keep]), "classes"
    )
    groups = store.save(classes.groupBy(group).agg(F.count("*").alias("classes")).where("classes > 1"), "groups")
    repeated = rows.where("n = 1").join(classes.where("total > 1").select(group, member), [group, member], "left_semi")
    open_ = classes.join(groups.select(group), group, "left_semi").withColumn("n", F.least("total", F.lit(2)).cast("int"))
    return repeated, open_.drop("total")


def _with_bodies(wanted: DataFrame, texts: DataFrame, kind: str) -> DataFrame:
    """The bytes around each row's windows, up to a block's width beyond, and where they begin."""
    lists = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("key", "lo", "hi", "p", "n")).alias("rows"))
    joined = _compressed(texts, kind).alias("d").join(
        lists.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.h") == F.col("w.h"))
    )

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        expand = zstandard.ZstdDecompressor().decompress

        def apply(batch):
            for i in range(batch.num_rows):
                body = expand(batch.column("body")[i].as_py())
                rows = batch.column("rows").slice(i, 1).flatten()
                lo, hi = (rows.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi"))
                begin, end = np.maximum(lo - BLOCK, 0), np.minimum(hi + LENGTH + BLOCK, len(body))
                of = pa.array(np.full(len(lo), i))
                yield {
                    "id": batch.column("id").take(of),
                    "h": batch.column("h").take(of),
                    **{k: rows.field(k) for k in ("key", "lo", "hi", "p", "n")},
                    "begin": begin.astype(np.int32),
                    "size": np.full(len(lo), len(body), np.int32),
                    "bytes": [body[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)],
                }

        return apply

    schema = f"id {kind}, h bigint, key bigint, lo int, hi int, p int, n int, begin int, size int, bytes binary"
    return map_batches(joined.select("d.id", "d.h", "body", "rows"), make, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Hashes, np.ndarray]]:
    """Parts of a batch whose bytes fit into one piece, and where each row's byte 0 would lie."""
    for at in range(0, batch.num_rows, 1000):
        part = batch.slice(at, 1000)
        bodies = part.column("bytes").to_pylist()
        lengths = np.array([len(x) for x in bodies], np.int64)
        begin = part.column("begin").to_numpy().astype(np.int64)
        yield part, Hashes(np.frombuffer(b"".join(bodies), np.uint8)), np.cumsum(lengths) - lengths - begin


def _numbers(part: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [part.column(c).to_numpy().astype(np.int64) for c in names]


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from first to last of each row, and the row."""
    count = last - first + 1
    row = np.repeat(np.arange(len(first)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]


def _block_rows(bodies: DataFrame, kind: str) -> DataFrame:
    """Rows of pass 3: block b of an anchor has the windows 16 b to 16 b + 15 before it."""

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            for part, hashes, zero in _slices(batch):
                lo, hi, p, size = _numbers(part, "lo", "hi", "p", "size")
                row, block = _ranges((p - hi) // BLOCK, (p - lo) // BLOCK)
                last = p[row] - BLOCK * block  # the block's last window, its first is 15 before
                first = last - BLOCK + 1
                core = hashes.of(zero[row] + last, zero[row] + first + LENGTH)
                left, right = np.maximum(first, 0), np.minimum(last + LENGTH, size[row])
                whole = hashes.of(zero[row] + left, zero[row] + right)
                key = part.column("key").to_numpy().view(np.uint64)[row]
                at = pa.array(row)
                yield {
                    "g": _signed(mixed(key * np.uint64(31) + core + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))),
                    "whole": _signed(mixed(whole + (left - first).astype(np.uint64) * np.uint64(977))),
                    **{c: part.column(c).take(at) for c in ("id", "h", "n")},
                    "row": part.column("lo").take(at),
                    "lo": np.maximum(lo[row], first).astype(np.int32),
                    "hi": np.minimum(hi[row], last).astype(np.int32),
                }

        return apply

    return map_batches(bodies, make, f"g bigint, whole bigint, id {kind}, h bigint, n int, row int, lo int, hi int")


def _window_rows(bodies: DataFrame, kind: str) -> DataFrame:
    """Rows of pass 4: the windows w_lo to w_hi one by one."""

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            for part, hashes, zero in _slices(batch):
                lo, hi, p = _numbers(part, "w_lo", "w_hi", "p")
                row, start = _ranges(lo, hi)
                key = part.column("key").to_numpy().view(np.uint64)[row]
                at = pa.array(row)
                yield {
                    "g": _signed(mixed(key + (p[row] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))),
                    "whole": _signed(hashes.of(zero[row] + start, zero[row] + start + LENGTH)),
                    **{c: part.column(c).take(at) for c in ("id", "h")},
                    "n": part.column("w_n").take(at),
                    "lo": start.astype(np.int32),
                }

        return apply

    return map_batches(bodies, make, f"g bigint, whole bigint, id {kind}, h bigint, n int, lo int")


def repeated_windows(texts: DataFrame, kind: str, store: Store) -> list[DataFrame]:
    """Tables (id, h, lo, hi): the windows from lo to hi start strings that also start elsewhere."""
    rows = _anchor_rows(texts, kind)
    often = store.save(rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"), "often")
    kept = store.save(rows.join(often, "key", "left_semi").withColumn("n", F.lit(1)), "anchors")
    done, open_ = sorted_pass(kept, "key", "wide", ["id", "h", "lo", "hi", "p"], store)
    bodies = store.save(_with_bodies(open_, texts, kind), "bytes")
    blocks = store.save(_block_rows(bodies, kind), "blocks")
    done_blocks, open_ = sorted_pass(blocks, "g", "whole", ["id", "h", "row", "lo", "hi"], store)
    named = open_.select(
        F.col("id").alias("w_id"), F.col("h").alias("w_h"), "row", F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi"),
        F.col("n").alias("w_n"),
    )
    wanted = bodies.join(
        named, bodies["id"].eqNullSafe(named["w_id"]) & (bodies["h"] == named["w_h"]) & (bodies["lo"] == named["row"])
    )
    windows = store.save(
        _window_rows(wanted.select("id", "h", "key", "p", "begin", "bytes", "w_lo", "w_hi", "w_n"), kind), "windows"
    )
    again = windows.groupBy("g", "whole").agg(F.sum("n").alias("total")).where("total > 1").select("g", "whole")
    done_windows = windows.where("n = 1").join(again, ["g", "whole"], "left_semi").withColumn("hi", F.col("lo"))
    return [x.select("id", "h", "lo", "hi") for x in (done, done_blocks, done_windows)]


def remove_repeated(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, removed, kept): the removed spans of bytes, and what is left as binary."""
    kind = docs.schema[id_column].dataType.simpleString()
    texts, store = _identified(docs, id_column, text), Store(docs.sparkSession, "suffix")
    found = repeated_windows(texts, kind, store)
    every = found[0].unionByName(found[1]).unionByName(found[2])
    # a set, as rows of equal id and text bring the same windows
    lists = every.groupBy("id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("windows"))
    joined = _compressed(texts, kind).alias("d").join(
        lists.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.h") == F.col("w.h")), "left"
    )

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        expand = zstandard.ZstdDecompressor().decompress

        def apply(batch):
            out = []
            for body, windows in zip(batch.column("body"), batch.column("windows"), strict=True):
                raw = np.frombuffer(expand(body.as_py()), np.uint8)
                covered = np.zeros(len(raw) + 1, np.int32)
                if windows.is_valid:
                    np.add.at(covered, windows.values.field("lo").to_numpy(), 1)
                    np.add.at(covered, windows.values.field("hi").to_numpy() + LENGTH, -1)
                gone = np.cumsum(covered)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
                out.append((len(raw), turns.reshape(-1, 2), raw[~gone].tobytes()))
            yield {
                "id": batch.column("id"),
                "n_bytes": [x[0] for x in out],
                "removed": [[{"start": a, "end": b} for a, b in x[1].tolist()] for x in out],
                "kept": [x[2] for x in out],
            }

        return apply

    schema = f"id {kind}, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"
    return map_batches(joined.select("d.id", "body", "windows"), make, schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, x: total + x["end"] - x["start"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
