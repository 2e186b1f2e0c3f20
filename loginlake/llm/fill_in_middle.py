"""Fill-in-middle transformation as an Arrow compute pipeline.

A text is cut into units (runs of A-Z and a-z; any other code point by itself), two cuts taken from
a hash of the id divide the units into prefix, middle and suffix, and the parts are put in
prefix-suffix-middle ("psm") or suffix-prefix-middle ("spm") order behind marks, or the text stays as
it is ("plain"). Everything about an id comes from its hash, so a repeated task gives the same rows.

The work per slice of a batch is columns only: units as list arrays, flattened with the index of their
parent, their ordinals, a filter by role, lists rebuilt for each role, and their pieces joined. The hash
numbers are Spark expressions. There is no shuffle and no state beyond a slice, which ends at
SLICE_BYTES of text; a longer text is a slice by itself.

A null text is an empty one, and empty texts are plain. A null id hashes like an empty number. Repeated
rows and ids give equal rows. Texts with a mark in them are plain, so that the marks of an output can be
trusted; for the same reason restoring needs the output and its form only. Other columns are not read,
so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, read_table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: A unit as bytes of UTF-8: letters, another ASCII byte, or a lead byte with those that follow it.
UNIT = rb"[A-Za-z]+|[\x00-@\[-`{-\x7f]|[\xc2-\xf4][\x80-\xbf]+"
#: No byte of UTF-8, so it can stand before each unit.
CUT = b"\xff"
SLICE_BYTES = 4 << 20
#: Of 100 ids, those that are transformed, and of 100 transformed ones, those in "spm" order.
TRANSFORMED, SPM = 90, 20


def hash_number(id_column: Column, group: int) -> Column:
    """The group-th run of eight digits, from 1, in the SHA-256 of "1:" and the id, as a number."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("bigint")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes in a column; a longer value is a part by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def units(texts: pa.Array) -> pa.ListArray:
    """The units of each text (large binary), behind one empty entry."""
    marked = pc.replace_substring_regex(texts, pattern=b"(" + UNIT + b")", replacement=CUT + rb"\1")
    return pc.split_pattern(marked, pattern=CUT)


def _remainder(x: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _joined(values: pa.Array, counts: pa.Array) -> pa.Array:
    """Values in lists of so many each, every list as one piece."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts.to_numpy())]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), pa.scalar(b"", pa.large_binary()))


def transformed(texts: pa.Array, h1: pa.Array, h2: pa.Array, plain: pa.Array, spm: pa.Array) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts (large binary, no nulls)."""
    lists = units(texts)
    n = pc.subtract(pc.cast(pc.list_value_length(lists), pa.int64()), 1)
    places = pc.add(n, 1)
    first, second = _remainder(h1, places), _remainder(h2, places)
    low, high = pc.min_element_wise(first, second), pc.max_element_wise(first, second)

    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = lists.offsets.slice(0, len(lists)).cast(pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(flat)) + lists.offsets[0].as_py()), pc.take(starts, parent))
    # ordinal 0 is the empty entry, so unit k has ordinal k + 1
    in_prefix = pc.less_equal(ordinal, pc.take(low, parent))
    in_suffix = pc.greater(ordinal, pc.take(high, parent))
    in_middle = pc.and_(pc.invert(in_prefix), pc.invert(in_suffix))
    prefix = _joined(flat.filter(in_prefix), pc.add(low, 1))
    middle = _joined(flat.filter(in_middle), pc.subtract(high, low))
    suffix = _joined(flat.filter(in_suffix), pc.subtract(n, high))

    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, pattern=mark))
    plain = pc.or_(plain, pc.equal(pc.binary_length(texts), 0))
    p, s, m, none = (pa.scalar(x, pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE, b""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    other = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)

    def chars(part: pa.Array) -> pa.Array:
        return pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(part.cast(pa.large_string())), pa.int64()))

    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": chars(prefix),
        "middle_chars": chars(middle),
        "output": pc.if_else(plain, texts, pc.if_else(spm, other, psm)),
    }


def restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts (large binary) that gave these outputs in these forms."""
    plain, spm = pc.equal(forms, "plain"), pc.equal(forms, "spm")
    # a plain output may hold any marks, so that only the others are cut
    parts = pc.split_pattern_regex(pc.if_else(plain, pa.scalar(PREFIX + SUFFIX + MIDDLE, pa.large_binary()), outputs), pattern="<[PSM]>")
    first, second, middle = (pc.list_element(parts, k) for k in (1, 2, 3))
    none = pa.scalar(b"", pa.large_binary())
    joined = pc.binary_join_element_wise(pc.if_else(spm, second, first), middle, pc.if_else(spm, first, second), none)
    return pc.if_else(plain, outputs, joined)


def fill_in_middle(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    transformed_of_100: int = TRANSFORMED,
    spm_of_100: int = SPM,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row."""
    kind = docs.schema[id_column].dataType.simpleString()
    key = F.col(id_column)
    rows = docs.select(
        key.alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        hash_number(key, 1).alias("h1"),
        hash_number(key, 2).alias("h2"),
        (hash_number(key, 3) % 100 >= transformed_of_100).alias("plain"),
        (hash_number(key, 4) % 100 < spm_of_100).alias("spm"),
    )

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            for part in slices(batch, "text", slice_bytes):
                texts = part.column("text").cast(pa.large_binary())
                out = transformed(texts, *(part.column(c) for c in ("h1", "h2", "plain", "spm")))
                yield {"id": part.column("id")} | out | {"output": out["output"].cast(pa.large_string())}

        return apply

    return map_batches(rows, make, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rows: DataFrame, names: list[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of fill_in_middle with the text rebuilt from output and form, in the column "restored".
    names: the other columns to keep, all by default."""
    kept = [c for c in names or rows.columns if c != "restored"]
    schema = rows.select(*kept).schema.add("restored", "string")

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            for part in slices(batch, "output", slice_bytes):
                texts = restored(part.column("output").cast(pa.large_binary()), part.column("form"))
                yield {c: part.column(c) for c in kept} | {"restored": texts.cast(pa.large_string())}

        return apply

    return map_batches(rows, make, schema)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's output and of the text rebuilt from it."""
    return restore(fill_in_middle(read_table(spark, sf_dir, "documents"))).select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


OP13_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents
),
numbers AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n,
         ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2,
         ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4
  FROM hashed
),
parts AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
         array_to_string(units[high + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {TRANSFORMED}
              THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""
