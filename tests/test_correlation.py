"""Window jobs against the line-by-line account, with chunks from tiny to whole."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loginlake import schemas
from loginlake.operators import failures, labels, sessions
from tests import model

KINDS = ("accepted", "session_opened", "session_closed", "invalid_user", "failed_password", "max_auth", "preauth_closed")
AS_OF = "2026-03-20"


def random_log(seed, n, pids=4, hot=0.4):
    """Few process ids, users and addresses, so that states meet; one id has a big share."""
    rnd = random.Random(seed)
    start = datetime(2026, 3, 8)
    rows = []
    for seq in range(n):
        kind = rnd.choice(KINDS)
        host = "a" if rnd.random() < 0.8 else "b"
        pid = "1" if rnd.random() < hot else str(rnd.randrange(pids))
        reports = kind in ("invalid_user", "failed_password")
        user = rnd.choice("xy") if reports else rnd.choice("uvw")
        moment = start + timedelta(seconds=seq * 40 + rnd.randrange(-200, 200))
        rows.append(
            {
                "host": host, "pid": pid, "seq": seq, "kind": kind,
                "user": "" if kind == "preauth_closed" else user,
                "source_ip": "" if kind.startswith("session") else "10.0.0." + rnd.choice("12"),
                "port": str(1000 + seq) if kind in ("accepted", "failed_password") else "",
                "auth_method": rnd.choice(("password", "publickey")) if kind == "accepted" else "",
                "invalid_user": kind in ("failed_password", "max_auth") and rnd.random() < 0.8,
                "fwd_host": "", "fwd_port": "", "ts": moment, "line": "",
            }
        )
    return rows


def frame(spark, rows):
    names = schemas.auth_events().fieldNames()
    return spark.createDataFrame([[r[n] for n in names] for r in rows], schemas.auth_events()).repartition(3)


def collected(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("seed,bits", [(1, 0), (2, 1), (3, 2), (4, 3), (5, 5), (6, 20)])
def test_jobs_agree_with_the_account(spark, seed, bits):
    rows = random_log(seed, 260)
    events = frame(spark, rows).cache()
    opens, pairs, still, failed = model.walk(rows)
    open_columns = ("host", "pid", "open_seq", "user", "source_ip", "auth_method", "port", "login_time")
    assert collected(sessions.session_opens(events, bits), *open_columns) == sorted(opens)
    assert collected(sessions.open_sessions(events, bits), *open_columns) == sorted(still)
    got = collected(sessions.sessions(events, AS_OF, bits), *open_columns, "close_seq", "logout_time", "duration_seconds")
    want = [(*p[:9], p[10], (p[10] - p[7]).total_seconds()) for p in pairs]
    assert got == sorted(want)
    got = collected(failures.failed_attempts(events, bits), "seq", "user", "source_ip", "port", "type")
    assert got == sorted(failed)


@pytest.mark.parametrize("bits", [0, 2, 4])
def test_one_endless_run_on_one_process(spark, bits):
    """A third and more of the log is one report repeated on one process id."""
    rows = random_log(9, 200, hot=0.0)
    for row in rows[20:180]:
        row.update(host="a", pid="1", kind="invalid_user", user="x", source_ip="10.0.0.1", port="", invalid_user=False)
    rows[100].update(kind="failed_password", invalid_user=True, port="77")
    _, _, _, failed = model.walk(rows)
    got = collected(failures.failed_attempts(frame(spark, rows), bits), "seq", "user", "source_ip", "port", "type")
    assert got == sorted(failed)


@pytest.mark.parametrize("seed", [11, 12])
def test_registry_agrees_with_the_account(spark, seed):
    rows = random_log(seed, 120)
    for row in rows[::7]:
        row["user"] = row["user"] and f"n{row['seq'] % 5}"
    caps = {"user": 4, "source_ip": 1, "auth_method": 1}
    got = labels.label_registry(frame(spark, rows), AS_OF, caps).rows.collect()
    want = model.registry(rows, caps)
    for dimension in caps:
        named = [r.value for r in sorted(got, key=lambda r: r.position) if r.dimension == dimension]
        assert named == want[dimension]


def test_file_positions_as_order(spark):
    """The order of scanned files (a struct) chunks and correlates like a number."""
    rows = random_log(21, 200)
    _, pairs, _, failed = model.walk(rows)
    seq = F.struct(
        F.lit(-1).cast("long").alias("file_order"), F.lit(7).cast("long").alias("file_id"),
        (F.col("seq") - F.col("seq") % 50).cast("long").alias("block_start"),
        (F.col("seq") + (F.col("seq") % 50) * 0 + F.lit(1 << 33)).alias("row_id"),
    )
    events = frame(spark, rows).withColumn("n", F.col("seq")).withColumn("seq", seq)
    got = sessions.sessions(events, AS_OF, chunk_bits=3).select("close_seq.row_id").collect()
    assert sorted(r.row_id - (1 << 33) for r in got) == sorted(p[8] for p in pairs)
    got = failures.failed_attempts(events, chunk_bits=3).select("seq.row_id", "port").collect()
    assert sorted((r.row_id - (1 << 33), r.port) for r in got) == sorted((f[0], f[3]) for f in failed)
