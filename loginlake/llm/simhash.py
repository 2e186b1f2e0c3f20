"""Near duplicates by SimHash, with candidates from tables of distances to pivots.

A fingerprint's row of the pivot table holds its Hamming distances to 65 reference
fingerprints: a base, and for each of four blocks of 16 bits the base changed by 16 Walsh masks
within the block. If two fingerprints differ in d bits, no coordinate differs by more than d;
and in a block without a differing bit all 16 distances relative to the base are the same. Two
bits leave at least two of four blocks alone, so fingerprints that link agree in the relative
distances of one of six pairs of blocks, which are the bucket keys. Within a bucket, pairs whose
largest coordinate difference is above the limit are discarded and the others verified bit by bit.

A bucket of more than 256 different fingerprints is dealt out anew: its remaining bits are four
smaller blocks, of which two agree again, until 8 bits remain, in which no more than 256
fingerprints can differ. So no group grows with the data and no link is lost. A bucket gives one
link per fingerprint, to the least of its linked set. Equal fingerprints are one row.

Null and empty texts have fingerprint zero and link like any other. Null ids are kept and never
name a component that has another id. Repeated rows share fingerprint and component. Only the
id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, Store, map_batches, read_table, utf8
from .components import components

SEED = 42
SHINGLE, MAX_BITS = 3, 2
BUCKET = 256
#: Any value does; its bits decide which fingerprints are near to the pivots.
BASE = 0x9E3779B97F4A7C15
ONES = np.uint64(0x0101010101010101)


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    words = body.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts, n = [b" ".join(words)], 1
    else:
        parts, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)), len(words) - shingle + 1
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), parts), np.uint64, n)
    # eight counters of a byte each per 64-bit sum, so 255 hashes at most go into one sum
    bits = (h >> np.arange(8, dtype=np.uint64)[:, None]) & ONES
    sums = np.add.reduceat(bits, np.arange(0, n, 255), axis=1)
    counts = sums.view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64).T.ravel()
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def fingerprints(
    docs: DataFrame, text: str = "text", shingle: int = SHINGLE, kept: list[str] | None = None, name: str = "fp"
) -> DataFrame:
    """The kept columns (all by default) and the fingerprint."""
    kept = [c for c in docs.columns if c != name] if kept is None else kept

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            found = np.fromiter((fingerprint(x, shingle) for x in utf8(batch, text)), np.uint64, batch.num_rows)
            yield {c: batch.column(c) for c in kept} | {name: signed(found)}

        return apply

    schema = docs.select(*kept).schema.add(name, "long")
    return map_batches(docs.select(*kept, *[text] * (text not in kept)), make, schema)


def _walsh(width: int) -> list[int]:
    """Masks of which the overlaps with a block of width bits determine the block."""
    return [(1 << width) - 1] + [
        sum(((i & j).bit_count() & 1) << j for j in range(width)) for i in range(1, width)
    ]


def _pivots(width: int, blocks: int) -> np.ndarray:
    return np.array([BASE ^ (m << (width * b)) for b in range(blocks) for m in _walsh(width)], np.uint64)


def distances(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ pivots).astype(np.int16)


PIVOTS = _pivots(16, 4)
#: Multipliers that turn the coordinates of two blocks into one key; equal keys of unequal
#: coordinates would only add candidates.
_MIX = np.random.default_rng(7).integers(1, 2**63, (4, 4, 16), dtype=np.uint64) | np.uint64(1)


def _relative(fps: np.ndarray, width: int) -> np.ndarray:
    """(n, block, pivot) distances relative to the base, for the four lowest blocks of width bits."""
    apart = distances(fps, _pivots(width, 4)) - distances(fps, np.array([BASE], np.uint64))
    return apart.reshape(len(fps), 4, width)


def bucket_keys(fps: np.ndarray, width: int) -> np.ndarray:
    """(n, 6) keys, one for each pair of the four lowest blocks of width bits."""
    coordinates = _relative(fps, width).astype(np.uint64)
    mixed = (coordinates * _MIX[width.bit_length() - 2, :, :width]).sum(axis=2)
    mixed ^= mixed >> np.uint64(29)
    pairs = list(combinations(range(4), 2))
    return np.stack(
        [(mixed[:, i] * np.uint64(2 * k + 3) + mixed[:, j]) * np.uint64(0xBF58476D1CE4E5B9) for k, (i, j) in enumerate(pairs)],
        axis=1,
    )


def _rest(fps: np.ndarray, pair: int, width: int) -> np.ndarray:
    """The bits of the two blocks outside the pair, side by side."""
    i, j = [b for b in range(4) if b not in list(combinations(range(4), 2))[pair]]
    w, mask = np.uint64(width), np.uint64((1 << width) - 1)
    return ((fps >> np.uint64(width * i)) & mask) | (((fps >> np.uint64(width * j)) & mask) << w)


def _bucket_rows(fps: DataFrame) -> DataFrame:
    """(key, way, rest, fp): rest is what can still differ in the bucket."""

    def make():
        def apply(batch):
            fp = batch.column("fp").to_numpy().view(np.uint64)
            keys = bucket_keys(fp, 16)
            for k in range(6):
                yield {"key": signed(keys[:, k].copy()), "rest": signed(_rest(fp, k, 16)), "fp": signed(fp)}

        return apply

    return map_batches(fps.select("fp"), make, "key bigint, rest bigint, fp bigint")


def _dealt_anew(rows: DataFrame, width: int) -> DataFrame:
    """The rows of large buckets by smaller blocks of what can still differ."""

    def make():
        def apply(batch):
            key, rest = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "rest"))
            keys = bucket_keys(rest, width)
            for k in range(6):
                mixed = (keys[:, k] ^ (key * np.uint64(0x94D049BB133111EB))) + np.uint64(width)
                yield {"key": signed(mixed), "rest": signed(_rest(rest, k, width)), "fp": batch.column("fp")}

        return apply

    return map_batches(rows.select("key", "rest", "fp"), make, "key bigint, rest bigint, fp bigint")


def linked_sets(fps: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For each fingerprint of a bucket the index of the first one of its linked set."""
    table = distances(fps, PIVOTS)
    i, j = np.triu_indices(len(fps), 1)
    for at in range(0, table.shape[1], 16):  # the largest coordinate difference, sixteen pivots at a time
        near = np.abs(table[i, at : at + 16] - table[j, at : at + 16]).max(axis=1) <= max_bits
        i, j = i[near], j[near]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
    i, j = i[near], j[near]
    first = np.arange(len(fps))
    while True:
        least = first.copy()
        np.minimum.at(least, i, first[j])
        np.minimum.at(least, j, first[i])
        least = least[least]
        if (least == first).all():
            return first
        first = least


def _links(rows: DataFrame, max_bits: int) -> DataFrame:
    """rows come sorted by key within a partition; a bucket may be cut by the end of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.concatenate((held_key, batch.column("key").to_numpy()))
            fp = np.concatenate((held, batch.column("fp").to_numpy().view(np.uint64)))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            yield from found(key[:last], fp[:last])
            held_key, held = key[last:], fp[last:]
        yield from found(held_key, held)

    def found(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        out_a, out_b = [], []
        for at, end in zip(starts, np.append(starts[1:], len(key)), strict=True):
            own = np.unique(fp[at:end])
            if len(own) > 1:
                first = linked_sets(own, max_bits)
                moved = first != np.arange(len(own))
                out_a.append(own[moved])
                out_b.append(own[first[moved]])
        if out_a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(x))) for x in (out_a, out_b)], names=["a", "b"]
            )

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_links(fps: DataFrame, store: Store, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links that join all fingerprints of fps (distinct, column fp) within max_bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"two of four blocks agree only up to {MAX_BITS} bits")
    rows, ready = _bucket_rows(fps), []
    for width in (8, 4, None):
        rows = store.save(rows, "buckets")
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = rows.join(sizes, "key")
        if width is None:  # 8 bits remain
            ready.append(sized)
            break
        ready.append(sized.where(F.col("n") <= BUCKET))
        rows = _dealt_anew(sized.where(F.col("n") > BUCKET), width)
    every = ready[0].select("key", "fp")
    for more in ready[1:]:
        every = every.unionByName(more.select("key", "fp"))
    return _links(every.repartition("key").sortWithinPartitions("key"), max_bits)


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """(id, fp, component): the component is the least id that links lead to."""
    store = Store(docs.sparkSession, "simhash")
    slim = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    found = store.save(fingerprints(slim, "text", shingle, ["id"]), "fingerprints")
    placed = _placed(found.groupBy("fp").agg(F.min("id").alias("first")), store, max_bits)
    named = placed.groupBy("root").agg(F.min("first").alias("component"))
    members = placed.select("fp", "root").join(named, "root").select("fp", "component")
    return found.join(members, "fp")


def _placed(distinct: DataFrame, store: Store, max_bits: int) -> DataFrame:
    """distinct (one row per fp) with the root fingerprint of each one's component."""
    roots = components(near_links(distinct.select("fp"), store, max_bits), store).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def representatives(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of docs that have the least id of their component, null ids last; of rows that
    are alike in id and fingerprint one stays, and of equal ids that of the least fingerprint."""
    store = Store(docs.sparkSession, "simhash")
    slim = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    found = store.save(fingerprints(slim, "text", shingle, ["id"]), "fingerprints")
    counted = found.groupBy("fp", "id").agg(F.count("*").alias("rows"))
    least = counted.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "fp", "rows")).alias("first"))
    placed = _placed(store.save(least, "least"), store, max_bits)
    name, fp, least_id, rows = free_names(docs, "stage_fp", "chosen_fp", "chosen_id", "chosen_rows")
    chosen = placed.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.fp").alias(fp), F.col("first.id").alias(least_id), F.col("first.rows").alias(rows)
    )
    chosen = store.save(chosen, "chosen")
    full = fingerprints(docs, text, shingle, name=name)
    kept = full.join(chosen, (full[name] == chosen[fp]) & full[id_column].eqNullSafe(chosen[least_id]))
    once = kept.where(F.col(rows) == 1).select(docs.columns)
    repeated = kept.where(F.col(rows) > 1).dropDuplicates([name]).select(docs.columns)
    return once.unionByName(repeated)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
