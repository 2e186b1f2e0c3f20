"""Token files next to the tokenizer library and to plain Python."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loginlake.llm import token_files
from loginlake.llm.common import Store
from loginlake.sources.files import filesystem

from .conftest import odd_rows

PATH = public_tokenizers.path(token_files.VOCABULARY)


@pytest.fixture(scope="module")
def plain():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids + [token_files.END]


def texts():
    rng = random.Random(11)
    parts = ["don't", "'s", '"\'s', "it's.", "end.", "(a)", "a'b", "É.", "İ.", "ß,", "J̌x", "é.", "ﬁ", "K.", "½", "2024", "x1.5", "漢字。", "🙂!"]
    parts += [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", " ", "​", "Σας.", "ΑΣ", "'", "''", "'LL", "'ll", "?'ve", ".'re", "word", "The"]
    parts += ["<|endoftext|>", "<|", "≮", "≠.", ".́", "a-b", "A_B", "`x`", "~", "\x00", "ŉ.", "Ω."]
    out = ["", " ", "\n", *parts]
    out += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    return out


def test_pieces_are_the_library(plain):
    coder = token_files.PieceEncoder(PATH, remembered=50)
    for lot in (texts(), texts()[:7], [""], []):
        ids, counts = coder.encode(pa.array(lot, pa.string()))
        ends = np.cumsum(counts)
        got = [ids[e - n : e].tolist() + [token_files.END] for e, n in zip(ends, counts, strict=True)]
        assert got == [plain(x) for x in lot]


@pytest.mark.parametrize("top", [1 << 8, 1 << 16, 1 << 24, (1 << 32) - 1])
def test_code_and_back(top):
    rng = np.random.default_rng(top % 97)
    counts = np.array([0, 1, 2, 3, 4, 5, 0, 9, 1000, 0])
    values = rng.integers(0, top, counts.sum()).astype(np.uint32)
    values[:4] = [0, 255, 256 % top, top - 1]
    control, data = token_files.code(values, counts)
    assert [len(x) for x in control.to_pylist()] == [-(-n // 4) for n in counts]
    want = [b"".join(struct.pack("<I", v)[: max(1, (int(v).bit_length() + 7) // 8)] for v in values[e - n : e]) for n, e in zip(counts, np.cumsum(counts))]
    assert data.to_pylist() == want
    assert (token_files.decode(b"".join(control.to_pylist()), b"".join(want), counts) == values).all()


def rows_of(spark, docs, tmp_path, **options):
    store = Store(spark, "tokens-test")
    stored = store.save(token_files.encode(docs, PATH, width="<u2").withColumn("row", F.monotonically_increasing_id()), "ids")
    token_files.write(stored, str(tmp_path / "files"), store, "<u2", **options)
    return token_files.read(spark, str(tmp_path / "files"))


@pytest.mark.parametrize("block_bytes", [1, 3000, token_files.BLOCK_BYTES])
def test_files(spark, odd, plain, tmp_path, block_bytes):
    got = rows_of(spark, odd, tmp_path, block_bytes=block_bytes).collect()
    want = [(r[0], plain(r[1])) for r in odd_rows()]
    got.sort(key=lambda r: r.start)
    key = lambda i: (i is not None, i or 0)
    assert [r.id for r in got] == sorted((i for i, _ in want), key=key)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    order = lambda x: (key(x[0]), x[1])
    assert sorted(((r.id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=order) == sorted(want, key=order)


def test_files_of_lost_attempts_are_not_read(spark, odd, tmp_path):
    before = rows_of(spark, odd, tmp_path).count()
    (tmp_path / "files" / "part-00000-lost.ids").write_bytes(b"half a block")
    assert token_files.read(spark, str(tmp_path / "files")).count() == before


def test_frequent_ids_take_a_byte(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the same few words " * 50) for i in range(20)], "doc_id int, text string")
    rows = rows_of(spark, docs, tmp_path).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.start)] == list(range(20))
    files, path = filesystem(str(tmp_path / "files"))
    size = sum(f.size for f in files.get_file_info(pa.fs.FileSelector(path)) if f.path.endswith(".ids"))
    assert size < 20 * 201 * 1.25 + 8 * 600


def test_ids_of_text_type(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two"), (None, "no id"), ("a", None)], "doc_id string, text string")
    rows = sorted(rows_of(spark, docs, tmp_path).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == [None, "a", "b"] and rows[1].n_tokens == 1


def test_query(spark, folder, plain):
    rows = sorted(token_files.op12_token_files(spark, folder["full"]).collect(), key=lambda r: r.start)
    by_id = {r[0]: r[1] for r in odd_rows() if r[0] is not None}
    for r in rows:
        if r.doc_id is not None:
            ids = plain(by_id[r.doc_id])
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
    assert token_files.op12_token_files(spark, folder["empty"]).count() == 0
