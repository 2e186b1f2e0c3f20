"""Quality rules: fixed base rules, and robust multivariate outliers per language and source.

Each text gives counts (words, symbols, repeated lines and word windows, capitals, exclamation
marks), and these a vector of transformed rates. For every language and source the centre and
covariance of the vectors are minimum-covariance-determinant estimates: from median and median
deviation, concentration steps take the 75 % of rows that are nearest by Mahalanobis distance and
estimate from them anew. The steps are sums over all rows of all groups at once, so a source that
holds a third of all rows is pre-aggregated like the others. As clean text has no symbols at all,
covariances are regularised by the least spread that is taken to matter in each rate. A text is
rejected if its distance is above a quantile of the chi-squared distribution.

Texts that fail a base rule do not enter the estimates. Languages or sources with fewer than 60
texts share the estimate of their language, and languages with fewer share one of the rest; if
that has fewer too, nothing is rejected by distance. Null language and source are values like
others. Null and empty texts have no words and fail the base rule. Equal distances at the 75 %
mark are all taken. Repeated rows count as often as they occur. Texts are counted whole. Only the
id, text, language and source are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, map_batches, read_table, utf8

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
#: Base rules: least number of words, greatest share of repeated words in percent.
MIN_WORDS, MAX_REPEATED = 50, 50
SHARE, STEPS, MIN_GROUP = 0.75, 4, 60
#: Quantile of the chi-squared distribution above which a text is rejected.
QUANTILE = 1 - 1e-9
#: Each rate as SQL over the counts, and the least standard deviation that matters.
RATES = {
    "length": ("ln(word_chars / n_words)", 0.04),
    "symbols": ("ln(1 + 100 * n_symbols / n_words)", 0.3),
    "capitals": ("sqrt(n_capitals / word_chars)", 0.04),
    "exclaimed": ("ln(1 + 100 * n_exclaimed / n_words)", 0.3),
    "same_lines": ("sqrt(n_dup_lines / n_lines)", 0.15),
    "same_words": ("sqrt(n_repeat_words / n_words)", 0.12),
}
NAMES = tuple(RATES)
PAIRS = tuple((a, b) for i, a in enumerate(NAMES) for b in NAMES[i:])
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_capitals bigint, n_exclaimed bigint"


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def counts(body: bytes) -> tuple[int, ...]:
    words = body.split()
    joined = b"".join(words)
    continued = int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    lines = [x for x in body.split(b"\n") if x.strip()]
    return (
        len(words),
        len(joined) - continued,
        len(joined) - len(joined.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(joined) - len(joined.translate(None, CAPITALS)),
        joined.count(b"!"),
    )


def counted(docs: DataFrame, text: str, kept: list[str]) -> DataFrame:
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            rows = [counts(x) for x in utf8(batch, text)]
            yield {c: batch.column(c) for c in kept} | dict(zip(names, zip(*rows, strict=True), strict=True))

        return apply

    schema = docs.select(*kept).schema
    for x in names:
        schema = schema.add(x, "long")
    return map_batches(docs.select(*kept, text), make, schema)


def chi_squared_below(x: float, freedom: int) -> float:
    """The chi-squared distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = freedom / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= half / (a + n)
        total += term
    return min(1.0, total * exp(-half + a * log(half) - lgamma(a)))


def chi_squared_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared_below(middle, freedom) < share else (low, middle)
    return high


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds the group that estimates a row: language and source, or language, or the rest."""
    by_source = rows.groupBy("g_lang", "g_source").agg(F.count("*").alias("n"))
    small = F.col("n") < MIN_GROUP
    pooled = by_source.withColumn("pool", F.when(small, F.lit("language")).otherwise("source"))
    languages = pooled.where(small).groupBy("g_lang").agg(F.sum("n").alias("n_lang"))
    named = pooled.join(languages, "g_lang", "left").select(
        "g_lang",
        "g_source",
        F.when(~small, F.to_json(F.struct("g_lang", "g_source")))
        .when(F.col("n_lang") >= MIN_GROUP, F.to_json(F.struct("g_lang")))
        .otherwise("{}")
        .alias("g"),
    )
    return rows.join(named, ["g_lang", "g_source"])


def _distance(start: bool) -> Column:
    if start:
        parts = [F.pow((F.col(a) - F.col(f"m_{a}")) / F.col(f"s_{a}"), 2) for a in NAMES]
    else:
        parts = [
            F.col(f"i_{a}_{b}") * (F.col(a) - F.col(f"m_{a}")) * (F.col(b) - F.col(f"m_{b}")) * (1 if a == b else 2)
            for a, b in PAIRS
        ]
    return sum(parts[1:], parts[0])


def _inverted(moments: DataFrame, correction: float) -> DataFrame:
    """Centre and inverse covariance of each group from its sums."""
    p = len(NAMES)
    floors = np.diag([RATES[a][1] ** 2 for a in NAMES])

    def make() -> Callable[[pa.RecordBatch], Iterable[dict]]:
        def apply(batch):
            n = batch.column("n").to_numpy().astype(float)
            means = np.stack([batch.column(f"t_{a}").to_numpy() for a in NAMES], 1) / n[:, None]
            cov = np.zeros((len(n), p, p))
            for a, b in PAIRS:
                i, j = NAMES.index(a), NAMES.index(b)
                cov[:, i, j] = cov[:, j, i] = batch.column(f"q_{a}_{b}").to_numpy() / n - means[:, i] * means[:, j]
            inverse = np.linalg.inv(cov * correction + floors)
            yield {"g": batch.column("g")} | {f"m_{a}": means[:, i] for i, a in enumerate(NAMES)} | {
                f"i_{a}_{b}": inverse[:, NAMES.index(a), NAMES.index(b)] for a, b in PAIRS
            }

        return apply

    columns = [f"m_{a} double" for a in NAMES] + [f"i_{a}_{b} double" for a, b in PAIRS]
    return map_batches(moments, make, ", ".join(["g string", *columns]))


def robust_estimates(rows: DataFrame, store: Store, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """(g, m_..., i_...): centre and inverse covariance of each group g of at least MIN_GROUP rows."""
    p = len(NAMES)
    correction = share / chi_squared_below(chi_squared_quantile(share, p), p + 2)
    medians = rows.groupBy("g").agg(
        F.count("*").alias("n"), *[F.percentile_approx(a, 0.5, 2000).alias(f"m_{a}") for a in NAMES]
    ).where(F.col("n") >= MIN_GROUP)
    spread = rows.join(medians, "g").groupBy("g").agg(
        *[F.first(f"m_{a}").alias(f"m_{a}") for a in NAMES],
        *[
            F.greatest(F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5, 2000) * 1.4826, F.lit(RATES[a][1])).alias(f"s_{a}")
            for a in NAMES
        ],
    )
    model = store.save(spread, "start")
    for step in range(steps):
        near = rows.join(model, "g").withColumn("apart", _distance(start=step == 0))
        limits = near.groupBy("g").agg(F.percentile_approx("apart", share, 2000).alias("limit"))
        taken = near.join(limits, "g").where(F.col("apart") <= F.col("limit"))
        moments = taken.groupBy("g").agg(
            F.count("*").alias("n"),
            *[F.sum(a).alias(f"t_{a}") for a in NAMES],
            *[F.sum(F.col(a) * F.col(b)).alias(f"q_{a}_{b}") for a, b in PAIRS],
        )
        before, model = model, store.save(_inverted(moments, correction), "model")
        store.drop(before)
    return model


def judge(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, counts..., base_failed, apart, kept): apart is the squared distance, null if a base
    rule failed or no estimate could be made."""
    store = Store(docs.sparkSession, "quality")
    slim = docs.select(
        F.col(id_column).alias("id"),
        F.to_json(F.struct(F.col(lang).alias("v"))).alias("g_lang"),
        F.to_json(F.struct(F.col(source).alias("v"))).alias("g_source"),
        F.col(text).alias("text"),
    )
    found = store.save(counted(slim, "text", ["id", "g_lang", "g_source"]), "counts")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    rates = [F.when(~F.col("base_failed"), F.expr(sql)).alias(a) for a, (sql, _) in RATES.items()]
    sound = _grouped(found.where(~failed).select("g_lang", "g_source", *rates))
    sound = store.save(sound.select("g", "g_lang", "g_source", *NAMES), "rates")
    model = robust_estimates(sound, store)
    placed = sound.select("g", "g_lang", "g_source").distinct().join(model, "g").drop("g")
    limit = chi_squared_quantile(QUANTILE, len(NAMES))
    return (
        found.select("*", *rates)
        .join(placed, ["g_lang", "g_source"], "left")
        .withColumn("apart", F.when(~F.col("base_failed"), _distance(start=False)))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("apart") <= limit, F.lit(True)))
        .select("id", *[x.split()[0] for x in COUNTS.split(", ")], "base_failed", "apart", "kept")
    )


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )
