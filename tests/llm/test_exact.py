"""Operators with a defined exact result, against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import tiktoken
import public_tokenizers
import xxhash

from loginlake.llm import bpe, catalog, decontaminate, line_dedup, pseudonyms, quality, secrets, simhash, suffix_dedup

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def sha(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


@pytest.fixture(scope="module", params=["odd", "table"])
def tables(request, folder, spark):
    where = folder["full"] if request.param == "odd" else "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()]
    return where, docs


def test_suffix_dedup(spark, tables):
    where, docs = tables
    bodies = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[s : s + 200] for _, b in bodies for s in range(len(b) - 199))
    expected = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(gone)))
        expected.append((i, len(b), sum(gone), spans, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    got = catalog.queries()["op4_suffix_dedup"](spark, where)
    assert order(map(tuple, got.collect())) == order(expected)


def test_pieces_of_long_texts_give_the_rows_of_the_whole(monkeypatch):
    raw = np.random.default_rng(8).integers(97, 123, 20_000).astype(np.uint8)
    raw[9_000:9_700] = 97
    rows = lambda: [x for part in suffix_dedup.anchors(raw) for x in zip(*(part[k].tolist() for k in part), strict=True)]
    whole = rows()
    for size in (100, 169, 700, 19_801, 19_900):
        monkeypatch.setattr(suffix_dedup, "PIECE", size)
        assert rows() == whole
    assert list(suffix_dedup.anchors(raw[:199])) == [] and sum(len(x["p"]) for x in suffix_dedup.anchors(raw[:200])) == 1


def test_unique_text_of_several_pieces_is_kept(spark):
    body = np.random.default_rng(9).integers(97, 123, 3 * suffix_dedup.PIECE).astype(np.uint8).tobytes()
    texts = [(1, body.decode()), (2, body[5_000:5_300].decode())]
    got = suffix_dedup.remove_repeated(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r.id: [tuple(x) for x in r.removed] for r in got} == {1: [(5_000, 5_300)], 2: [(0, 300)]}


def test_bpe(spark, tables):
    where, docs = tables
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in docs:
        ids = plain.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert order(map(tuple, catalog.queries()["op5_bpe"](spark, where).collect())) == order(expected)


def test_long_words_encode_alike():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    words = {"a" * 700, "ab" * 300} | {"".join(rng.choice(list(s), 300)) for s in ("etaoin", "aab", "abcdefghijklmnop") for _ in range(5)}
    for word, (ids, decoded) in bpe.Encoder(ranks).words(words).items():
        assert np.frombuffer(ids, np.int32).tolist() == plain.encode_ordinary(word)
        assert decoded == word.encode()


def test_quality_counts(spark, tables):
    where, docs = tables
    expected = []
    for i, t in docs:
        t = t or ""
        words = SPACE.findall(t)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines, same = set(), 0
        for line in t.split("\n"):
            same += bool(SPACE.search(line)) and line in lines
            lines.add(line)
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        expected.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), same, len(again), failed))
    got = [tuple(r) for r in catalog.queries()["op6_quality"](spark, where).collect()]
    assert order(r[:7] for r in got) == order(expected)
    assert not any(r[6] and r[7] for r in got)


def plain_fingerprint(text: str) -> int:
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps: list[int], ids: list) -> list:
    label = dict.fromkeys(fps)
    for f in label:
        if label[f] is None:
            todo, label[f] = [f], f
            while todo:
                x = todo.pop()
                for g in label:
                    if label[g] is None and (x ^ g).bit_count() <= 2:
                        label[g] = f
                        todo.append(g)
    least = {}
    for f, i in zip(fps, ids, strict=True):
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return [least.get(label[f]) for f in fps]


def test_simhash(spark, tables):
    where, docs = tables
    fps = [plain_fingerprint(t or "") for _, t in docs]
    expected = [
        (i, f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, plain_components(fps, [i for i, _ in docs]), strict=True)
    ]
    assert order(map(tuple, catalog.queries()["op8_simhash"](spark, where).collect())) == order(expected)


def test_dense_fingerprints_are_dealt_anew(spark, monkeypatch):
    """A cluster that overfills buckets, at every level of blocks."""
    from loginlake.llm.common import Store
    from loginlake.llm.components import components

    rng = np.random.default_rng(3)
    flips = [0] + [1 << int(a) | 1 << int(b) for a, b in rng.integers(0, 20, (500, 2))]
    flips += [int(x) for x in rng.integers(0, 2**12, 400)] + [int(x) << 40 for x in rng.integers(0, 2**9, 200)]
    fps = sorted({0x0123456789ABCDEF ^ x for x in flips} | {int(x) for x in rng.integers(0, 2**63, 300)})
    monkeypatch.setattr(simhash, "BUCKET", 16)
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), f % 1000) for f in fps], "fp bigint, first bigint")
    store = Store(spark, "test")
    found = components(simhash.near_links(table.select("fp"), store), store)
    roots = {r.node: r.root for r in found.collect()}
    label = {f: roots.get(f, f) for f in (int(np.uint64(x).view(np.int64)) for x in fps)}
    names = dict(zip(fps, plain_components(fps, list(range(len(fps)))), strict=True))
    groups = {}
    for f in fps:
        groups.setdefault(names[f], set()).add(label[int(np.uint64(f).view(np.int64))])
    assert all(len(x) == 1 for x in groups.values()) and len(set().union(*groups.values())) == len(groups)


ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I
)


def test_secrets(spark, tables):
    where, docs = tables
    expected = {}
    for i, t in docs:
        b = (t or "").encode()
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(b) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", b) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(rb"[0-9a-f]+", b) if len(m[0]) >= 24]
        names = ("assign", "access", "hex")
        text = ",".join(f"{names[k]}:{len(b[:s].decode())}:{len(b[:e].decode())}" for s, k, e in sorted(spans))
        row = (i, *(sum(x[1] == k for x in spans) for k in range(3)), sha(text.encode()))
        expected.setdefault(row, 0)
    got = catalog.queries()["op9_secret_scan"](spark, where).collect()
    assert {tuple(r)[:5] for r in got} == set(expected)


def test_secret_rules_and_redaction(spark):
    key = "ghp_" + "a1B2" * 9
    text = f"é {key} xoxb-1234567890-abc and token=abcdefgh é"
    docs = spark.createDataFrame([(text,)], "text string")
    row = secrets.scan(docs).withColumn("clean", secrets.redact(secrets.F.col("text"), secrets.F.col("spans"))).first()
    assert [(s.kind, text[s.start : s.end]) for s in row.spans] == [
        ("github", key), ("slack", "xoxb-1234567890-abc"), ("assign", "token=abcdefgh")
    ]
    assert row.clean == "é [secret] [secret] and [secret] é"


def test_lines(spark, tables):
    where, docs = tables
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest())
    first, holders = {}, {}
    for i, t in sorted(set(docs), key=rank):
        for start, _, unit in line_dedup.units(t or ""):
            first.setdefault(unit, (i, t, start))
            holders.setdefault(unit, set()).add((i, t))
    expected = []
    for i, t in docs:
        found = line_dedup.units(t or "")
        marks = [len(holders[u]) > 1 for *_, u in found]
        n = 0
        chosen = []
        while n < len(found):
            end = n
            while end < len(found) and marks[end]:
                end += 1
            if sum(len(u.split(" ")) for *_, u in found[n:end]) >= line_dedup.MIN_WORDS:
                chosen += found[n:end]
            n = max(end, n + 1)
        if not chosen:
            continue
        gone = [(a, b) for a, b, u in chosen if first[u] != (i, t, a)]
        kept = "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in gone))
        spans = ",".join(f"{a}:{b}" for a, b in gone)
        expected.append((i, len(found), len(chosen), first[chosen[0][2]][0], len(gone), spans, sha(kept.encode())))
    got = list(map(tuple, catalog.queries()["op2_line_dedup"](spark, where).collect()))
    assert order(got) == order(expected) and any(r[4] for r in got) and any(not r[4] for r in got)


def test_runs_of_sentences(spark):
    """Runs go on over line ends and blank pieces, short ones and repeats inside one document stay."""
    shared = " ".join(f"word{k}" for k in range(14))
    rows = [
        (1, f"Own start. {shared}.\n\n{shared} too.\nOwn end."),
        (2, f"Other start. {shared}. ... \n{shared} too.\nOther end."),
        (3, f"{shared}.\nAlone."),
        (4, "\n".join(["This line repeats inside one document only and has many words."] * 9)),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.id: r for r in line_dedup.drop_repeated(docs, min_words=28).collect()}
    assert [got[i].n_repeated for i in (1, 2, 3, 4)] == [2, 0, 0, 0]
    got = {r.id: r for r in line_dedup.drop_repeated(docs, min_words=14).collect()}
    assert [got[i].n_repeated for i in (1, 2, 3, 4)] == [2, 2, 1, 0]
    assert got[1].kept == rows[0][1] and got[2].kept == "Other start. ... \n\nOther end." and got[3].kept == "\nAlone."
    assert [got[i].first_id for i in (1, 2, 3, 4)] == [1, 1, 1, None]


def test_rows_without_id_stay_apart(spark):
    """Texts are told apart by 128 bits; equal rows are one document."""
    shared = " ".join(f"w{k}" for k in range(40)) + "."
    rows = [(None, shared + " Mine."), (None, shared + " Yours."), (None, shared + " Yours."), (None, "Only here. " * 3)]
    got = line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(len(r.removed) for r in got) == [0, 0, 1, 1] or sorted(len(r.removed) for r in got) == [0, 0, 0, 1]
    assert len(got) == 4


def test_bpe_of_texts_in_one_batch(spark):
    """Texts without words between others, whole batches without any, and words up to the length of a short one."""
    path = public_tokenizers.path(bpe.VOCABULARY)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [None, "", "same same\n\n same", "", "z" * 63, " " + "ab" * 31, "z" * 64, "same", None]
    for some in (texts, [None, "", None], texts[2:3]):
        docs = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string").coalesce(1)
        got = bpe.encode(docs, path).orderBy("doc_id").collect()
        assert [bytes(r.decoded).decode() for r in got] == [x or "" for x in some]
        assert [r.ids for r in got] == [plain.encode_ordinary(x or "") for x in some]


def test_units_of_every_document_are_counted(spark):
    """Also of those in which nothing is repeated."""
    shared = " ".join(f"w{k}" for k in range(40)) + "."
    rows = [(1, shared + " Mine."), (2, shared + "\nYours. Really!"), (3, "Alone here. Twice.\nOr more?"), (4, ""), (5, None), (None, "One.")]
    got = line_dedup.drop_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.id: r.n_units for r in got} == {1: 2, 2: 3, 3: 3, 4: 0, 5: 0, None: 1}


def test_pseudonyms():
    feistel = pseudonyms.Feistel(b"k")
    for space in ((10, 10), (1, 7), (13, 17)):
        n = space[0] * space[1]
        assert sorted(feistel.permute(x, *space, "p") for x in range(n)) == list(range(n))
    text = "Card 4111 1111 1111 1111, call +1 (386) 555-3733 or 386-555-3733. é On 2024-02-29, 123-45-6789 from 10.0.0.1, ab.9@x.example.org"
    found = pseudonyms.pseudonyms(text, feistel)
    assert [k for _, _, k, _ in found] == ["card", "phone", "phone", "date", "ssn", "ip", "email"]
    digits = lambda s: re.sub(r"\D", "", s)[-10:]
    assert digits(found[1][3]) == digits(found[2][3]) != digits(text[found[1][0] : found[1][1]])
    for a, b, kind, new in found:
        again = pseudonyms.pseudonyms(f"x {new} y", feistel)
        assert again and again[0][2] == kind and new != text[a:b]
        if kind in ("card", "phone", "ssn", "date"):
            assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text[a:b])
    for wrong in ("4111 1111 1111 1112", "2023-02-29", "999.1.1.1", "000-12-3456", "user@", "@x.org"):
        assert not pseudonyms.pseudonyms(f"x {wrong} y", feistel)


def test_decontamination(spark, tables):
    """Bounds skip nothing: every item whose own window score is above the threshold is retrieved."""
    where, docs = tables
    items = [tuple(r) for r in spark.read.parquet(f"{where}/benchmark.parquet").select("item_id", "text").collect()]
    plain = decontaminate.Index(items, block=10**6)
    expected = []
    for i, t in docs:
        words = decontaminate.split_words(t or "")
        for number, item in enumerate(plain.items):
            best = None
            for k in range(len(words) // plain.step + 1):
                window = words[k * plain.step : (k + 2) * plain.step]
                terms = np.array(sorted({plain.terms[w] for w in window if w in plain.terms}), int)
                scores = np.zeros(len(plain.items))
                for term in terms:
                    at = slice(plain.postings[term], plain.postings[term + 1])
                    scores[plain.item[at]] += plain.impact[at]
                grams = decontaminate.shingles(window, len(next(iter(item.question))))
                if (
                    scores[number] >= 1
                    and len(item.question & grams) >= 0.8 * len(item.question)
                    and sum(w in window for w in item.answer) >= 0.8 * len(item.answer)
                ):
                    best = max(best or 0, scores[number])
            if best:
                expected.append((i, item.id, round(best, 9)))
    got = catalog.queries()["op10_decontamination"](spark, where).collect()
    assert order((r.doc_id, r.item_id, round(r.score, 9)) for r in got) == order(expected)


def test_chi_squared():
    assert abs(quality.chi_squared_quantile(0.95, 6) - 12.5916) < 1e-3


def test_number_of_shards_changes_nothing(spark, tables, monkeypatch):
    where, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    items = spark.read.parquet(f"{where}/benchmark.parquet")

    def found():
        rows = decontaminate.add_matches(docs.select("doc_id", "text"), items).select("doc_id", decontaminate.F.explode("matches").alias("m"))
        key = lambda r: (str(r.doc_id), r.m.item_id, r.m.first_word)
        return [(r.doc_id, r.m.item_id, round(r.m.score, 9), r.m.first_word, r.m.end_word) for r in sorted(rows.collect(), key=key)]

    whole = found()
    chars = sum(len(r.text or "") for r in items.collect())
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", chars // 2)
    assert whole and found() == whole


def test_equal_rows_without_id(spark):
    """Many equal rows are each other's repetition, and each comes out once."""
    text = " ".join(f"w{k}" for k in range(120))
    rows = [(None, text)] * 30 + [(None, "another text of its own " + text[:50])]
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(len(r.kept) for r in got) == [0] * 30 + [74]
