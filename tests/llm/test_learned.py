"""Learned operators: accuracy on rows held out of learning."""

import numpy as np
import pytest

from loginlake.llm import catalog, language_id, toxicity

TABLES = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang").toPandas()


def test_language(spark, docs):
    got = catalog.queries()["op7_language_id"](spark, TABLES).toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_ranks_by_hand():
    grams = language_id.gram_codes("ab ab")
    codes, n = language_id.counted(grams)
    assert n.sum() == len(grams) == 4 + 6 + 4  # letters, pairs with blanks, triples within words
    ranks = language_id.Ranks([("x", int(g), k + 1) for k, g in enumerate(codes)], 10)
    assert ranks.predict(None, 300) == ("und", 0.0) and ranks.predict("12 .", 300) == ("und", 0.0)
    assert ranks.predict("ab", 300)[0] == "x"


def test_toxicity(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "toxic").toPandas()
    got = catalog.queries()["op1_toxicity"](spark, TABLES).toPandas()
    assert got.score.between(0, 1).all()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97


def near(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_product_automaton_finds_what_distance_allows():
    rng = np.random.default_rng(4)
    terms = ["idiot", "loser", "disgusting", "scum", "worthless", "moron"]
    lexicon = toxicity.Lexicon([(t, True, 1.0) for t in terms])
    words = ["".join(rng.choice(list("idotlserwhmcu"), rng.integers(4, 9))) for _ in range(500)]
    for t in terms:
        for _ in range(60):
            letters = list(t)
            for _ in range(rng.integers(0, 3)):
                at = rng.integers(0, len(letters))
                letters[at : at + rng.integers(0, 2)] = rng.choice(list("xyzaio"), rng.integers(0, 2)).tolist()
            words.append("".join(letters))
    for word in words:
        expected = [t for t in terms if near(word, t) <= toxicity.errors_allowed(t)]
        if len(word) >= 4:
            assert bool(lexicon.find(word)) == bool(expected), word


def test_quotation():
    pieces = toxicity.PIECES.findall('he said "you idiot there" and left')
    assert toxicity.quotation(pieces, pieces.index("idiot")) == 1
    assert toxicity.quotation(["you", "idiot"], 1) == 0
