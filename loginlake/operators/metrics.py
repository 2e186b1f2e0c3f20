"""Counters, gauges and histograms, and the time-series questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sources import or_else
from ..schemas import DAY_NAMES, DURATION_BOUNDS, METRIC_SAMPLES
from .labels import LabelRegistry, apply_labels
from .sessions import with_details


def _counted(rows: DataFrame, labels: list[str], registry: LabelRegistry | None) -> DataFrame:
    """Rows per label set.

    With a registry the labels are few and mapped before the only shuffle; without
    one the raw values are counted first and details added to the counts.
    """
    raw = [c for c in labels if c != "source_display" or c in rows.columns]
    if registry is not None:
        if "source_ip" not in labels:
            raw = labels
        rows = apply_labels(rows.select(*[c for c in raw if c != "source_display"]), registry)
        return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("value"))
    counts = rows.groupBy(*raw).agg(F.count(F.lit(1)).alias("value"))
    return (with_details(counts) if "source_ip" in labels else counts).select(*labels, "value")


def _of(events: DataFrame, *kinds: str) -> DataFrame:
    return events.filter(F.col("kind").isin(*kinds))


def logins(events: DataFrame, registry: LabelRegistry | None = None, displays: DataFrame | None = None) -> DataFrame:
    """Accepted logins per user, source and method."""
    counts = _counted(_of(events, "accepted"), ["user", "source_ip", "source_display", "auth_method"], registry)
    return pin_displays(counts, displays)


def pin_displays(counts: DataFrame, displays: DataFrame | None) -> DataFrame:
    """Counts with each source shown under one name; ``displays`` is (value, display)."""
    if displays is None:
        return counts
    labels = [c for c in counts.columns if c != "value"]
    pinned = displays.select(F.col("value").alias("source_ip"), F.col("display").alias("_shown"))
    shown = counts.join(pinned, "source_ip", "left").withColumn(
        "source_display", F.coalesce("_shown", "source_display")
    )
    return shown.groupBy(*labels).agg(F.sum("value").alias("value"))


def logouts(events: DataFrame, registry: LabelRegistry | None = None) -> DataFrame:
    """Closed sessions per user of the closing line, matched to an open or not."""
    return _counted(_of(events, "session_closed"), ["user"], registry)


def failed_logins(failed: DataFrame, registry: LabelRegistry | None = None) -> DataFrame:
    return _counted(failed, ["user", "source_ip", "source_display"], registry)


def invalid_user_attempts(failed: DataFrame, registry: LabelRegistry | None = None) -> DataFrame:
    return failed_logins(failed.filter("invalid_user"), registry)


def preauth_closes(events: DataFrame, registry: LabelRegistry | None = None) -> DataFrame:
    return _counted(_of(events, "preauth_closed"), ["source_ip", "source_display"], registry)


_ERROR_TYPES = {"port_forward_error": "port_forward_failed", "max_auth": "max_auth_exceeded"}


def _error_type() -> Column:
    column = F.when(F.lit(False), "")
    for kind, name in _ERROR_TYPES.items():
        column = column.when(F.col("kind") == kind, name)
    return column


def errors(events: DataFrame) -> DataFrame:
    """Errors by type: failed port forwards and exceeded authentication attempts."""
    rows = _of(events, *_ERROR_TYPES).select(_error_type().alias("error_type"))
    return _counted(rows, ["error_type"], None)


def unique_users(events: DataFrame) -> DataFrame:
    """Distinct users of accepted and opened lines."""
    return _of(events, "accepted", "session_opened").select("user").distinct()


def unique_user_count(events: DataFrame, approximate: bool = False) -> DataFrame:
    users = _of(events, "accepted", "session_opened")
    count = F.approx_count_distinct("user") if approximate else F.count_distinct("user")
    return users.agg(count.alias("value"))


def timed_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions whose duration is known and not negative."""
    return sessions.filter(F.col("duration_seconds") >= 0)


def duration_histogram(sessions: DataFrame, registry: LabelRegistry | None = None) -> DataFrame:
    """(user, series, le, value): cumulative buckets, sum and count of durations."""
    seconds = F.col("duration_seconds")
    rows = apply_labels(timed_sessions(sessions).select("user", "duration_seconds"), registry)
    measures = [F.count_if(seconds <= le).cast("double").alias(f"b{le}") for le in DURATION_BOUNDS]
    wide = rows.groupBy("user").agg(
        *measures, F.sum(seconds).alias("total"), F.count(F.lit(1)).cast("double").alias("n")
    )
    cells = [("bucket", str(le), F.col(f"b{le}")) for le in DURATION_BOUNDS]
    cells += [("bucket", "+Inf", F.col("n")), ("sum", "", F.col("total")), ("count", "", F.col("n"))]
    long = F.array(
        *[F.struct(F.lit(s).alias("series"), F.lit(le).alias("le"), v.alias("value")) for s, le, v in cells]
    )
    return wide.select("user", F.inline(long))


def day_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in DAY_NAMES]), index)


def logins_by_hour(events: DataFrame) -> DataFrame:
    """(weekday, hour, n) of accepted logins that have a date; Monday is 0."""
    dated = _of(events, "accepted").filter(F.col("ts").isNotNull())
    return dated.groupBy(F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )


def login_heatmap(events: DataFrame) -> DataFrame:
    """(day_of_week, hour, value) for all 168 hours of a week."""
    return heatmap_of(logins_by_hour(events))


def heatmap_of(cells: DataFrame) -> DataFrame:
    """All hours of a week with the counts of ``cells`` (weekday, hour, n)."""
    spark = cells.sparkSession
    grid = spark.range(7 * 24).select(
        F.expr("cast(id div 24 as int)").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour")
    )
    counts = F.broadcast(cells)  # 168 rows at most
    return grid.join(counts, ["weekday", "hour"], "left").select(
        day_name(F.col("weekday")).alias("day_of_week"),
        F.lpad(F.col("hour").cast("string"), 2, "0").alias("hour"),
        F.coalesce("n", F.lit(0)).alias("value"),
    )


def latest_snapshot(snapshots: DataFrame) -> Column:
    """Id of the newest snapshot (one with no session counts), as a scalar subquery."""
    return snapshots.agg(F.max("snapshot_id").alias("s")).scalar()


def active_session_gauge(active: DataFrame, snapshots: DataFrame, registry: LabelRegistry | None = None) -> DataFrame:
    """Sessions per label set in the newest snapshot; 0 for sets of earlier ones."""
    here = F.col("snapshot_id") == latest_snapshot(snapshots)
    rows = active.select("user", "source_ip", "source_display", here.alias("here"))
    if registry is None:
        rows = rows.withColumn("source_ip", or_else(F.col("source_ip"), F.col("source_display")))
    rows = apply_labels(rows, registry)
    return rows.groupBy("user", "source_ip", "source_display").agg(
        F.count_if("here").alias("value")
    )


def user_online(known_users: DataFrame, active: DataFrame, snapshots: DataFrame, registry: LabelRegistry | None = None) -> DataFrame:
    """1 for users in the newest snapshot, 0 for all others known from log or snapshots."""
    here = F.col("snapshot_id") == latest_snapshot(snapshots)
    rows = known_users.select("user", F.lit(0).alias("online")).unionByName(
        active.select("user", here.cast("int").alias("online"))
    )
    return apply_labels(rows, registry).groupBy("user").agg(F.max("online").cast("bigint").alias("value"))


def active_total(gauge: DataFrame) -> DataFrame:
    return gauge.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))


def per_window(rows: DataFrame, ts: str, width: str, slide: str | None, *by: str, **measures: Column) -> DataFrame:
    """Sums of ``measures`` per time window (and ``by``).

    Overlapping windows are built from sums per slide, so that rows are not copied
    once per window.
    """
    step = slide or width
    pane = F.window(ts, step)
    panes = rows.filter(F.col(ts).isNotNull()).groupBy(*by, pane.alias("pane")).agg(
        *[m.alias(name) for name, m in measures.items()]
    )
    starts = panes.withColumn("pane_start", F.col("pane.start"))
    return starts.groupBy(*by, F.window("pane_start", width, step).alias("w")).agg(
        *[F.sum(name).alias(name) for name in measures]
    ).select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *measures)


def failed_per_hour(failed: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Failed attempts per window of time."""
    return per_window(failed, "timestamp", width, slide, value=F.count(F.lit(1)))


def average_duration(sessions: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Average duration of the sessions that ended in a window, per user."""
    sums = per_window(
        timed_sessions(sessions), "logout_time", width, slide, "user",
        total=F.sum("duration_seconds"), n=F.count(F.lit(1)),
    )
    return sums.select("user", "window_start", "window_end", (F.col("total") / F.col("n")).alias("value"))


def _samples(df: DataFrame, metric: str | Column, kind: str, labels: list[str]) -> DataFrame:
    """A metric frame in the layout of ``METRIC_SAMPLES``; NULL labels are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in labels]) if labels else None
    present = (
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
        if labels
        else F.from_json(F.lit("{}"), "map<string,string>")
    )
    return df.select(
        (metric if isinstance(metric, Column) else F.lit(metric)).alias("metric"),
        F.lit(kind).alias("type"),
        present.alias("labels"),
        F.col("value").cast("double").alias("value"),
    )


_EVENT_COUNTERS = {
    "accepted": ("ssh_logins_total", ("user", "source_ip", "source_display", "auth_method")),
    "session_closed": ("ssh_logouts_total", ("user",)),
    "preauth_closed": ("ssh_preauth_connection_closed_total", ("source_ip", "source_display")),
    "port_forward_error": ("ssh_errors_total", ("error_type",)),
    "max_auth": ("ssh_errors_total", ("error_type",)),
}
_COUNTER_LABELS = ["user", "source_ip", "source_display", "auth_method", "error_type"]


def event_counters(events: DataFrame, registry: LabelRegistry | None = None) -> DataFrame:
    """The counters that need no correlation, in one pass: metric, labels, value.

    Labels a metric does not have are NULL.  Also runs on a stream of events.
    """
    kind = F.col("kind")
    rows = apply_labels(
        with_details(_of(events, *_EVENT_COUNTERS)) if registry is None else _of(events, *_EVENT_COUNTERS), registry
    )
    rows = rows.withColumn("error_type", _error_type())

    def choose(name: str) -> Column:
        having = [k for k, (_, labels) in _EVENT_COUNTERS.items() if name in labels]
        return F.when(kind.isin(*having), F.col(name)).alias(name)

    metric = F.when(F.lit(False), "")
    for k, (name, _) in _EVENT_COUNTERS.items():
        metric = metric.when(kind == k, name)
    rows = rows.select(metric.alias("metric"), *[choose(c) for c in _COUNTER_LABELS])
    return rows.groupBy("metric", *_COUNTER_LABELS).agg(F.count(F.lit(1)).alias("value"))


def counter_samples(counters: DataFrame) -> DataFrame:
    """Counters (metric, labels, value) as samples."""
    return _samples(counters, F.col("metric"), "counter", _COUNTER_LABELS)


def gauge_samples(histogram: DataFrame, users: DataFrame, heatmap: DataFrame) -> list[DataFrame]:
    """Duration histogram, number of users and heatmap as samples."""
    bucket = F.col("series") == "bucket"
    histogram = histogram.withColumns(
        {"metric": F.concat(F.lit("ssh_session_duration_seconds_"), "series"), "le": F.when(bucket, F.col("le"))}
    )
    return [
        _samples(histogram, F.col("metric"), "histogram", ["user", "le"]),
        _samples(users, "ssh_unique_users_total", "gauge", []),
        _samples(heatmap, "ssh_login_heatmap", "gauge", ["day_of_week", "hour"]),
    ]


def metric_samples(
    events: DataFrame,
    sessions: DataFrame,
    failed: DataFrame,
    registry: LabelRegistry | None = None,
    snapshots: DataFrame | None = None,
    active: DataFrame | None = None,
    snapshot_registry: LabelRegistry | None = None,
) -> DataFrame:
    """All metric families as (metric, type, labels, value) rows."""
    user_source = ["user", "source_ip", "source_display"]
    frames = [
        counter_samples(event_counters(events, registry)),
        _samples(failed_logins(failed, registry), "ssh_failed_logins_total", "counter", user_source),
        _samples(invalid_user_attempts(failed, registry), "ssh_invalid_user_attempts_total", "counter", user_source),
        *gauge_samples(duration_histogram(sessions, registry), unique_user_count(events), login_heatmap(events)),
    ]
    if active is not None:
        names = snapshot_registry if snapshot_registry is not None else registry
        gauge = active_session_gauge(active, snapshots, names)
        online = user_online(unique_users(events), active, snapshots, names)
        frames += [
            _samples(gauge, "ssh_active_sessions", "gauge", user_source),
            _samples(online, "ssh_user_online", "gauge", ["user"]),
        ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result.select(*METRIC_SAMPLES.fieldNames())
