"""Failed attempts, with doubled reports of one invalid user merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .chunks import CHUNK_BITS, IN_CHUNK, KEY, KEY_VALUES, add_chunk
from .sessions import with_details


def _same(a: str, b: str) -> str:
    return f"coalesce({a}.user = {b}.user AND {a}.source_ip = {b}.source_ip, false)"


def _carry(tails: DataFrame) -> DataFrame:
    """Per chunk: length of the run that enters it, and the row right behind the chunk.

    ``tails`` has the last row of each chunk.  A run of equal (user, address) rows
    goes on into a chunk if the chunk starts with the last row's values; chunks that
    are one run through and through pass their own entering length on.
    """
    order = "PARTITION BY host, pid ORDER BY chunk"
    rows = tails.selectExpr(
        *KEY, "chunk", "row", "head", "run_start IS NULL AS one_run",
        "pos - coalesce(run_start, 1) + 1 AS run",
    ).selectExpr(
        "*",
        f"lag(struct(row, run, one_run)) OVER ({order}) AS prev",
        f"lead(head) OVER ({order}) AS next_head",
    )
    rows = rows.selectExpr(
        *KEY, "chunk", "next_head",
        f"if({_same('prev.row', 'head')}, prev.run, 0) AS added",
        f"{_same('prev.row', 'head')} AND prev.one_run AS passes",
    ).selectExpr("*", f"sum(added) OVER ({order}) AS total")
    return rows.selectExpr(
        *KEY, "chunk", "next_head",
        f"total - max(if(passes, NULL, total - added)) OVER ({order}) AS carry",
    )


def report_chunks(events: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Reports of invalid users with their place in their chunk.

    ``run_start`` is where the run of equal reports that a report belongs to begins, NULL
    for the run that the chunk begins with; ``next`` is the following report in the chunk
    and ``head`` the chunk's first one.
    """
    rows = events.filter("kind = 'invalid_user' OR (kind = 'failed_password' AND invalid_user)")
    fields = ["user", "source_ip", "kind", "port", "ts"]
    if "source_display" in events.columns:
        fields += ["source_hostname", "source_display"]
    rows = rows.selectExpr(*KEY_VALUES, "seq", f"struct({', '.join(fields)}) AS row")
    rows = add_chunk(rows, chunk_bits).selectExpr(
        "*",
        f"row_number() OVER ({IN_CHUNK}) AS pos",
        f"lag(row) OVER ({IN_CHUNK}) AS prev",
        f"lead(row) OVER ({IN_CHUNK}) AS next",
        f"first(row) OVER ({IN_CHUNK}) AS head",
    )
    rows = rows.selectExpr(
        *KEY, "chunk", "seq", "row", "pos", "next", "head",
        f"if(prev IS NULL OR {_same('prev', 'row')}, NULL, pos) AS break",
    )
    return rows.selectExpr("*", f"max(break) OVER ({IN_CHUNK}) AS run_start").drop("break")


def invalid_user_runs(events: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Reports of invalid users with ``run_pos``, their place in a run of equal reports.

    A run is a series of reports of one process id with the same user and address
    and no other report between them.  Each odd one counts, each even one repeats
    the report before it; ``next`` is the following report of the process id.
    """
    rows = report_chunks(events, chunk_bits)
    carry = _carry(rows.filter("next IS NULL"))
    # most chunks are not affected by their neighbours
    carry = carry.filter("carry % 2 = 1 OR next_head IS NOT NULL")
    return rows.join(carry, [*KEY, "chunk"], "left").selectExpr(
        *KEY, "seq", "row", "coalesce(next, next_head) AS next",
        "pos - coalesce(run_start, 1) + 1 + if(run_start IS NULL, coalesce(carry, 0), 0) AS run_pos",
    )


def counted_invalid_users(runs: DataFrame) -> DataFrame:
    """The reports that count; an empty port is filled from the repeated report."""
    repeated = f"row.port = '' AND next.kind = 'failed_password' AND {_same('row', 'next')}"
    return runs.filter("run_pos % 2 = 1").selectExpr(
        *KEY, "seq", "row.*", f"if({repeated}, next.port, row.port) AS full_port"
    )


def invalid_users(events: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    return counted_invalid_users(invalid_user_runs(events, chunk_bits))


_ATTEMPT = (
    "ts AS timestamp", "user", "source_ip", "source_hostname", "source_display",
    "port", "type", "invalid_user", "seq",
)


def other_failures(events: DataFrame) -> DataFrame:
    """Failures that never repeat each other: known users, and exceeded attempts."""
    rows = events.filter("kind = 'max_auth' OR (kind = 'failed_password' AND NOT invalid_user)")
    rows = rows.withColumns(
        {
            "type": F.expr("if(kind = 'max_auth', 'max_auth_exceeded', 'failed_password')"),
            "port": F.expr("if(kind = 'max_auth', '', port)"),
        }
    )
    return with_details(rows).selectExpr(*_ATTEMPT)


def attempts_of(invalid: DataFrame) -> DataFrame:
    rows = with_details(invalid).drop("port").withColumnRenamed("full_port", "port")
    return rows.withColumns({"type": F.lit("invalid_user"), "invalid_user": F.lit(True)}).selectExpr(*_ATTEMPT)


def failed_attempts(events: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """All failed attempts: merged invalid users, failed passwords, exceeded attempts."""
    return attempts_of(invalid_users(events, chunk_bits)).unionByName(other_failures(events))
