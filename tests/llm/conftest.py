import random

import pytest

WORDS = "the of and to in idiot that was for on are with his they be at one have this from or had by".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ly", "tion", "x"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = sentence(rng, 6000)
    base = sentence(rng, 120)
    rows = [
        (1, None, "en", "a"),
        (2, "", None, "a"),
        (3, " \n\t ", "en", None),
        (4, "12345 !!", "en", "a"),
        (5, base, "en", "a"),
        (5, base, "en", "a"),
        (6, base, None, None),
        (7, base.replace("the", "teh", 1), "fr", "b"),
        (None, base[:600], "en", "a"),
        (None, "own text of a row without id, long enough to be a line", "en", "a"),
        (8, long, "en", "a"),
        (9, "é漢字🙂 " * 60, "zh", "c"),
        (10, "a" * 1500, "en", "a"),
        (11, "line one of some words here\nline one of some words here\n" + base, "en", "b"),
        (12, 'token = "0641917ea4e9feb9cda83477b57ac2654884f485" é password: abc', "en", "b"),
    ]
    for i in range(20, 60):
        words = sentence(rng, 90).split(" ")
        rows.append((i, " ".join(words), "en" if i % 2 else "fr", "a"))
        if i % 4 == 0:
            words[7] = "changed"
            rows.append((i + 100, " ".join(words), "en", "b"))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names clash with those of results."""
    rows = [(*r, len(r[1] or ""), 0.5, "z", [1], 7) for r in odd_rows()]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, ids array<int>, fp int"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def folder(spark, odd, tmp_path_factory):
    """The odd rows as tables in a folder, and empty ones in another."""
    top = tmp_path_factory.mktemp("odd")
    labels = [(i, i % 2, int("idiot" in (t or ""))) for i, t, _, _ in odd_rows() if i]
    base_text = odd_rows()[4][1]
    benchmark = [(1, odd_rows()[20][1][40:300]), (2, None), (3, "Too short."), (None, ""), (4, odd_rows()[20][1][40:300])]
    talk = [(1, None, "user", base_text), (1, 2, None, "b"), (1, 2, None, "b"), (2, 0, "user", None), (None, 1, "user", "c"), (3, 1, "user", base_text)]
    for name, keep in (("full", True), ("empty", False)):
        for table, df in (
            ("documents", odd),
            ("labels", spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")),
            ("benchmark", spark.createDataFrame(benchmark, "item_id bigint, text string")),
            ("conversations", spark.createDataFrame([(*r, 0, "x") for r in talk], "conv_id bigint, turn bigint, role string, text string, depth int, ids string")),
        ):
            (df if keep else df.limit(0)).write.parquet(f"{top}/{name}/{table}.parquet")
    return {"full": f"{top}/full", "empty": f"{top}/empty"}
