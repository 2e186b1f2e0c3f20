"""Accepts, opens and closes of a process id joined into sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sources import add_source_details
from ..functions.timestamps import as_of_column
from .chunks import CHUNK_BITS, EARLIER, IN_CHUNK, IN_KEY, KEY, UP_TO, WHOLE, add_chunk

ACCEPTED, OPENED, CLOSED = "accepted", "session_opened", "session_closed"
_ACCEPT_FIELDS = ("source_ip", "source_hostname", "source_display", "auth_method", "port")


def with_details(df: DataFrame) -> DataFrame:
    """Adds source_hostname and source_display unless an enrichment already did."""
    return df if "source_display" in df.columns else add_source_details(df, "source_ip")


_AUTH = f"kind IN ('{ACCEPTED}', '{OPENED}')"
_SESSION = f"kind IN ('{OPENED}', '{CLOSED}')"


def _attach(rows: DataFrame, window: str) -> DataFrame:
    """Settles, as far as the window's rows allow, what each open and close belongs to.

    ``login`` of an open is the accept right before it (each accept serves one
    open), ``open`` of a close is the open right before it.  ``settled`` tells
    whether the needed earlier row lies inside the window's partition.  ``last_auth``
    and ``is_last`` mark the partition's last accept or open, and open or close.
    """
    def is_last(condition: str) -> str:
        counted = f"count_if({condition}) OVER ({window}"
        return f"{condition} AND {counted} {UP_TO}) = {counted} {WHOLE})"

    rows = rows.selectExpr(
        "*",
        f"last(auth, true) OVER ({window} {EARLIER}) AS _auth",
        f"{is_last(_AUTH)} AS last_auth",
        f"{is_last(_SESSION)} AS is_last",
    )
    rows = rows.selectExpr(
        *KEY, "chunk", "seq", "kind", "user", "ts", "open", "last_auth", "is_last", "wanted",
        f"""if(kind = '{OPENED}' AND NOT settled,
            struct(kind, if(_auth.kind = '{ACCEPTED}', _auth.login, NULL) AS login), auth) AS auth""",
        f"settled OR kind = '{ACCEPTED}' OR (kind = '{OPENED}' AND _auth IS NOT NULL) AS settled",
    )
    state = f"struct(kind, user, auth.login AS login, ts, seq, settled OR kind = '{CLOSED}' AS settled)"
    rows = rows.selectExpr(
        "*", f"last(if({_SESSION}, {state}, NULL), true) OVER ({window} {EARLIER}) AS _open"
    )
    return rows.selectExpr(
        *KEY, "chunk", "seq", "kind", "user", "ts", "auth", "last_auth", "is_last", "wanted",
        f"if(kind = '{CLOSED}' AND NOT settled, _open, open) AS open",
        f"settled OR (kind = '{CLOSED}' AND coalesce(_open.settled, false)) AS settled",
    )


def in_chunks(
    events: DataFrame, kinds: tuple = (ACCEPTED, OPENED, CLOSED), chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """Accepts, opens and closes with what their own chunk tells about them, see ``_attach``."""
    rows = events.filter(F.col("kind").isin(*kinds))
    login = f"struct({', '.join(f for f in _ACCEPT_FIELDS if f in events.columns)})"
    rows = rows.selectExpr(
        *KEY, "seq", "kind", "user", "ts",
        f"if({_AUTH}, struct(kind, if(kind = '{ACCEPTED}', {login}, NULL) AS login), NULL) AS auth",
    )
    empty = "if(false, struct(kind, user, auth.login AS login, ts, seq, false AS settled), NULL) AS open"
    rows = rows.selectExpr("*", empty, "false AS settled")
    return _attach(add_chunk(rows, chunk_bits).withColumn("wanted", F.lit(False)), IN_CHUNK)


# what reaches beyond its chunk, and the rows such rows may refer to; the others are done
AT_EDGE = "NOT settled OR last_auth OR is_last"
DONE = f"kind <> '{ACCEPTED}' AND settled AND NOT is_last AND NOT last_auth"


def correlate(
    events: DataFrame, kinds: tuple = (ACCEPTED, OPENED, CLOSED), chunk_bits: int = CHUNK_BITS
) -> DataFrame:
    """One row per open and close: its own fields, ``login``, ``open`` and ``is_last``.

    ``is_last`` marks the last open or close of a (host, pid).  Accepts appear only
    where no accept or open follows, which ``is_last`` marks too.
    """
    rows = in_chunks(events, kinds, chunk_bits)
    columns = [*KEY, "seq", "kind", "user", "ts", "auth", "open", "is_last"]
    # both parts read the same columns of the same shuffle, which is made once
    inner = rows.filter(DONE).select(*columns)
    edge = rows.filter(AT_EDGE).withColumn("wanted", ~F.expr(DONE))
    edge = _attach(edge.drop("last_auth", "is_last"), IN_KEY)
    edge = edge.withColumn("is_last", F.expr(f"if(kind = '{ACCEPTED}', last_auth, is_last)"))
    edge = edge.filter(f"wanted AND (kind <> '{ACCEPTED}' OR is_last)").select(*columns)
    return inner.union(edge).withColumn("login", F.col("auth.login"))


def _login_fields(rows: DataFrame, login: str) -> DataFrame:
    """Adds the accept's details in the struct column ``login``, '' where there was none."""
    names = rows.select(f"{login}.*").columns
    rows = with_details(rows.selectExpr("*", *[f"coalesce({login}.{n}, '') AS {n}" for n in names]))
    shown = "coalesce(nullif(source_display, ''), nullif(source_ip, ''), source_hostname)"
    return rows.withColumn("source_display", F.expr(shown))


_DETAILS = ("source_ip", "source_hostname", "source_display", "auth_method", "port")


def session_opens(events: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Every open with the details of the accept it used up ('' without one)."""
    rows = correlate(events, (ACCEPTED, OPENED), chunk_bits)
    return _open_rows(rows.filter(F.col("kind") == OPENED))


def _open_rows(rows: DataFrame) -> DataFrame:
    return _login_fields(rows, "login").select(
        *KEY, "user", *_DETAILS, F.col("ts").alias("login_time"), F.col("seq").alias("open_seq")
    )


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def session_rows(correlated: DataFrame, as_of) -> DataFrame:
    """Finished sessions out of ``correlate``; a close without a date ends at ``as_of``."""
    rows = correlated.filter((F.col("kind") == CLOSED) & (F.col("open.kind") == OPENED))
    logout = F.coalesce("ts", as_of_column(as_of))
    return _login_fields(rows, "open.login").select(
        *KEY,
        F.col("open.user").alias("user"),
        *_DETAILS,
        F.col("open.ts").alias("login_time"),
        logout.alias("logout_time"),
        seconds_between(F.col("open.ts"), logout).alias("duration_seconds"),
        F.col("open.seq").alias("open_seq"),
        F.col("seq").alias("close_seq"),
        F.col("user").alias("close_user"),
    )


def sessions(events: DataFrame, as_of, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Finished sessions: each close with the latest unmatched open of its process id."""
    return session_rows(correlate(events, chunk_bits=chunk_bits), as_of).drop("close_user")


def open_sessions(events: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Sessions without a close: the last open or close of the process id is an open."""
    rows = correlate(events, chunk_bits=chunk_bits)
    return _open_rows(rows.filter((F.col("kind") == OPENED) & F.col("is_last")))
