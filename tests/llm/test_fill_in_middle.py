"""Fill-in-middle next to a plain version, and round trips."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from loginlake.llm import fill_in_middle as fim


def plain_version(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) of one text, unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(3)
    alphabet = ["a", "Zz", "word", " ", "\n", "\x00", "é", "ß", "漢", "🙂", "é", "<", "P>", "<S", ">", "<M", "1", "﻿", " "]
    out = [None, "", " ", "<P>", "a<S>b", "<P", "<<S<P", "only", "🙂", "\x7f\x80", "é" * 50, "x" * 100_000]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    out.append("".join(rng.choice(alphabet) for _ in range(60_000)))
    return out


@pytest.mark.parametrize("most", [1, 200, fim.SLICE_BYTES])
def test_plain_version(spark, most):
    rows = [(i, x) for i, x in enumerate(texts())] + [(7, "a repeated row"), (7, "a repeated row"), (None, "without id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    got = fim.restore(fim.fill_in_middle(docs, slice_bytes=most), slice_bytes=most).collect()
    key = lambda x: tuple((y is not None, y) for y in x)
    want = sorted(((i, *plain_version(i, x), x or "") for i, x in rows), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["abc", None, "", "d" * 9, "e", "f"]})
    for most in (1, 3, 4, 100):
        parts = list(fim.slices(batch, "text", most))
        assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
        assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= most for p in parts)


def test_no_transformed_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id bigint, text string")
    assert {r.form for r in fim.fill_in_middle(docs, transformed_of_100=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(docs, transformed_of_100=100, spm_of_100=100).collect()} == {"spm"}
    assert fim.restore(fim.fill_in_middle(docs.limit(0))).count() == 0
