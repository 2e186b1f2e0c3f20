"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank among all ids of the table (the most frequent one is 0, ties go to the
lesser id), and a rank takes the one to four bytes it needs. Lengths stand apart from the bytes: a
control byte holds those of four ranks, two bits each. Both ways are numpy on whole batches; a reader looks
the lengths of four ranks up in a table of 256 rows, adds them up to places, and masks the four bytes
that begin at each place.

encode() runs the tokenizer and stores ids; ranks() counts them over all rows; write() codes documents,
deals them by ranges of (id, hash of the codes, row) and lets every task write its range as one file of
the data source "ranked_ids"; spark.read.format("ranked_ids") gives the documents back, one task a file.

A folder holds

* ``ranks.bin``: the id of each rank, little-endian unsigned 32-bit integers;
* ``part-NNNNN-….ids``: blocks, one after the other. A block has a head (see HEAD: documents, and the bytes
  of the index, control and data parts), an index (Arrow stream with id and n_tokens of each document),
  the control bytes, and the data bytes. A document's control bytes begin at a byte of their own;
* ``manifest.json``: written last, when all tasks are done: the files in order of their documents with
  their numbers of documents and tokens, and the type of the id. Files not named there belong to
  attempts that were lost and are never read.

Documents are in ascending order of id, null first; documents of one id in order of a hash of their
codes. Equal rows are written one by one, each at its own place. A null or empty text has no token but the
end mark. An empty table gives a folder without data files. Very long texts are documents like others;
a block ends with the first document that brings it to BLOCK_BYTES. Other columns are not read, so
their names cannot clash.

The tokenizer works on distinct pieces: texts are cut at blanks and between a letter and an ASCII
punctuation mark that cannot begin a contraction, places where no normaliser or merge reaches across.
Texts with combining marks or the strings of special tokens are not cut.
"""

from __future__ import annotations

import functools
import io
import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.files import filesystem
from .common import Store, map_batches, read_table
from .fill_in_middle import slices

VOCABULARY = "word_bpe_49k.json"
END = 2
SLICE_BYTES = 8 << 20
#: Pieces a worker remembers; a full memory is emptied, which costs time only.
REMEMBERED = 400_000
BLOCK_BYTES = 8 << 20
#: Documents, bytes of index, control and data of a block.
HEAD = struct.Struct("<4sIQQQ")
MAGIC = b"RID1"

# cuts: after a letter and before punctuation, and the other way round; the apostrophe begins contractions
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
MARK = r"!-&(-/:-@\[-`{-~"
#: Letters without a mark that could be joined or lost, whose lower case is one letter.
WORD = re.compile(f"[{LETTER}]+")
#: Texts that are encoded whole.
UNCUT = r"\p{M}|<\|"


class PieceEncoder:
    """Ids of texts as the tokenizer gives them without special tokens, by way of distinct pieces."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.normal, self.split, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            ids = [t.id for t in self.model.tokenize(piece)]
        elif WORD.fullmatch(piece):  # normal but for case, and not to be split
            (part, _), *_ = self.letters.pre_tokenize_str(piece.lower())
            ids = [t.id for t in self.model.tokenize(part)]
        else:
            parts = self.split.pre_tokenize_str(self.normal.normalize_str(piece))
            ids = [t.id for part, _ in parts for t in self.model.tokenize(part)]
        return np.array(ids, "<u4").tobytes()

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that may be cut, and their number for each text."""
        cut = pc.ascii_lower(texts)
        cut = pc.replace_substring_regex(cut, f"([{LETTER}])([{MARK}])", r"\1 \2")
        cut = pc.replace_substring_regex(cut, f"([{MARK}])([{LETTER}])", r"\1 \2")
        lists = pc.ascii_split_whitespace(cut)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        if len(self.known) > self.remembered:
            self.known.clear()
        known, found = self.known, []
        for piece in coded.dictionary.to_pylist():
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self._piece(piece)
            found.append(ids)
        flat = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy()
        each = lengths[at]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[at] - (ends - each), each) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (strings without nulls) in a row, and their number for each text."""
        whole = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._pieces(texts)
        ids, counts = self._pieces(texts.filter(pa.array(~whole)))
        direct = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
        parts, both = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [], []
        cut, rest = iter(parts), iter(direct)
        for uncut in whole:
            both.append(next(rest) if uncut else next(cut))
        return np.concatenate(both), np.array([len(x) for x in both])


@functools.cache
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process, so that tasks share what it remembers."""
    return PieceEncoder(path)


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive values, so many a row, as the bytes of each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def joined(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of binaries()."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.frombuffer(b"".join(column.to_pylist()), dtype)
    return values, lengths // values.itemsize


def encode(docs: DataFrame, path: str, end: int | None = END, id_column: str = "doc_id", text: str = "text", width: str = "<u4") -> DataFrame:
    """(id, ids): the ids of each row as little-endian integers of a width, behind them the end mark."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        known = encoder(path)

        def apply(batch):
            for part in slices(batch, "text", SLICE_BYTES):
                ids, counts = known.encode(part.column("text"))
                if end is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
                yield {"id": part.column("id"), "ids": binaries(ids.astype(width), counts)}

        return apply

    return map_batches(rows, make, f"id {kind}, ids binary")


def ranks(encoded: DataFrame, width: str = "<u4") -> list[int]:
    """All ids that occur, the most frequent first. Their number is bounded by the vocabulary."""

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            values, _ = joined(batch.column("ids"), width)
            counts = np.bincount(values)
            token = np.nonzero(counts)[0]
            yield {"token": token, "n": counts[token]}

        return apply

    counts = map_batches(encoded.select("ids"), make, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return [r.token for r in counts.orderBy(F.desc("n"), "token").collect()]


def code(values: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control and data bytes of ranks, so many a document."""
    lengths = 1 + (values >= 1 << 8) + (values >= 1 << 16) + (values >= 1 << 24)
    slots = -(-counts // 4) * 4
    shift = np.cumsum(slots - counts) - (slots - counts)
    codes = np.zeros(int(slots.sum()), np.uint8)
    codes[np.arange(len(values)) + np.repeat(shift, counts)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    each = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.cumsum(counts)
    return binaries(control, slots // 4), binaries(data, each[ends] - each[ends - counts])


#: For each control byte the lengths of its four ranks, and for each length the bits of four bytes that count.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
BITS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of documents of so many each."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)
    slots = -(-counts // 4) * 4
    firsts = np.cumsum(slots) - slots
    total = int(counts.sum())
    real = np.arange(total) + np.repeat(firsts - (np.cumsum(counts) - counts), counts)
    lengths = lengths[real]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.frombuffer(data + bytes(4), np.uint8)
    four = np.lib.stride_tricks.as_strided(padded, (len(padded) - 3, 4), (1, 1), writeable=False)
    return four[at].view("<u4").reshape(-1) & BITS[lengths]


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str | None
    documents: int
    tokens: int


@dataclass
class Part(InputPartition):
    name: str | None
    start: int


class RankedIds(DataSource):
    """Folders of coded token ids; the option "path" names one."""

    @classmethod
    def name(cls) -> str:
        return "ranked_ids"

    def schema(self) -> str:
        return f"id {_manifest(self.options['path'])['id']}, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RankedReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RankedWriter(self.options["path"], schema, int(self.options.get("block_bytes", BLOCK_BYTES)))


def _manifest(folder: str) -> dict:
    files, path = filesystem(folder)
    with files.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


class RankedWriter(DataSourceArrowWriter):
    """Writes rows (id, n, control, data) as they come; every task makes one file."""

    def __init__(self, folder: str, schema: StructType, block_bytes: int):
        self.folder, self.schema, self.block_bytes = folder, schema, block_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        partition = TaskContext.get().partitionId()
        files, path = filesystem(self.folder)
        name, out = f"part-{partition:05d}-{uuid.uuid4().hex}.ids", None
        documents = tokens = held = 0
        block: list[pa.RecordBatch] = []
        for batch in iterator:
            for row in slices(batch, "data", self.block_bytes):
                out = out or files.open_output_stream(f"{path}/{name}")
                block.append(row)
                held += sum(pc.sum(pc.binary_length(row.column(c))).as_py() or 0 for c in ("control", "data"))
                documents += row.num_rows
                tokens += pc.sum(row.column("n")).as_py() or 0
                if held >= self.block_bytes:
                    out.write(_block(block))
                    block, held = [], 0
        if block:
            out.write(_block(block))
        if out is not None:
            out.close()
        return Written(partition, name if out is not None else None, documents, tokens)

    def commit(self, messages: list[Written | None]) -> None:
        """Names the files of the tasks that count; nothing can be read before."""
        files, path = filesystem(self.folder)
        done = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.partition)
        told = {"id": self.schema["id"].dataType.simpleString(), "files": [{"name": m.name, "documents": m.documents, "tokens": m.tokens} for m in done]}
        with files.open_output_stream(f"{path}/manifest.tmp") as f:
            f.write(json.dumps(told, indent=1).encode())
        files.move(f"{path}/manifest.tmp", f"{path}/manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        files, path = filesystem(self.folder)
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{path}/{m.name}")


def _block(rows: list[pa.RecordBatch]) -> bytes:
    table = pa.Table.from_batches(rows)
    index = io.BytesIO()
    head = pa.table({"id": table["id"], "n_tokens": table["n"]}).combine_chunks()
    with pa.ipc.new_stream(index, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
        f.write_table(head)
    control, data = (b"".join(table[c].to_pylist()) for c in ("control", "data"))
    return HEAD.pack(MAGIC, table.num_rows, index.tell(), len(control), len(data)) + index.getvalue() + control + data


class RankedReader(DataSourceReader):
    """One task a file; a block at a time is in memory."""

    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema = folder, schema

    def partitions(self) -> list[Part]:
        out, start = [], 0
        for file in _manifest(self.folder)["files"]:
            out.append(Part(file["name"], start))
            start += file["tokens"]
        return out or [Part(None, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.name is None:
            return
        files, path = filesystem(self.folder)
        with files.open_input_stream(f"{path}/ranks.bin") as f:
            of_rank = np.frombuffer(f.read(), "<u4")
        schema, start = to_arrow_schema(self.schema), partition.start
        with files.open_input_stream(f"{path}/{partition.name}") as f:
            while head := f.read(HEAD.size):
                magic, documents, *sizes = HEAD.unpack(head)
                if magic != MAGIC:
                    raise ValueError(f"no block where one should begin in {partition.name}")
                index, control, data = (f.read(n) for n in sizes)
                table = pa.ipc.open_stream(index).read_all().combine_chunks()
                counts = table["n_tokens"].to_numpy()
                ids = of_rank[decode(control, data, counts)]
                starts = start + np.cumsum(counts) - counts
                start += len(ids)
                arrays = [table["id"].combine_chunks(), pa.array(starts), pa.array(counts), binaries(ids, counts)]
                yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(arrays, schema, strict=True)], schema=schema)


def write(encoded: DataFrame, folder: str, store: Store, width: str = "<u4", block_bytes: int = BLOCK_BYTES) -> None:
    """Writes stored rows (id, ids, row) of encode() to a new folder that all machines share; row tells equal
    rows apart. The rows are dropped as soon as their codes are stored, from which the ranges are then drawn."""
    spark = encoded.sparkSession
    of_rank = np.array(ranks(encoded, width), "<u4")
    files, path = filesystem(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/ranks.bin") as f:
        f.write(of_rank.tobytes())

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        files, path = filesystem(folder)
        with files.open_input_stream(f"{path}/ranks.bin") as f:
            tokens = np.frombuffer(f.read(), "<u4")
        rank = np.zeros(int(tokens.max(initial=0)) + 1, np.uint32)
        rank[tokens] = np.arange(len(tokens))

        def apply(batch):
            for part in slices(batch, "ids", SLICE_BYTES):
                values, counts = joined(part.column("ids"), width)
                control, data = code(rank[values], counts)
                yield {"id": part.column("id"), "row": part.column("row"), "n": counts, "control": control, "data": data}

        return apply

    kind = encoded.schema["id"].dataType.simpleString()
    coded = map_batches(encoded.select("id", "ids", "row"), make, f"id {kind}, row bigint, n bigint, control binary, data binary")
    keys = ["id", "hash", "row"]
    coded = store.save(coded.withColumn("hash", F.xxhash64("control", "data")), "codes")
    store.drop(encoded)
    register(spark)
    (
        coded.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("id", "n", "control", "data")
        .write.format("ranked_ids")
        .option("path", folder)
        .option("block_bytes", block_bytes)
        .mode("append")
        .save()
    )
    store.drop(coded)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RankedIds)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of each document: ids of all documents before it, the number of its own,
    and these as little-endian unsigned 32-bit integers."""
    register(spark)
    return spark.read.format("ranked_ids").load(folder)


def encode_to_files(docs: DataFrame, path: str, folder: str | None = None, id_column: str = "doc_id", text: str = "text", end: int | None = END) -> str:
    """Encodes documents and writes them; returns the folder, by default a new one in the shared folder."""
    from tokenizers import Tokenizer

    width = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
    store = Store(docs.sparkSession, "tokens")
    rows = encode(docs, path, end, id_column, text, width).withColumn("row", F.monotonically_increasing_id())
    stored = store.save(rows, "ids", compression="zstd")
    folder = folder or f"{store.folder}/files"
    write(stored, folder, store, width)
    return folder


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents, as read back from the files."""
    folder = encode_to_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return read(spark, folder).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
