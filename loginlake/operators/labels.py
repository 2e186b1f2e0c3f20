"""Bounded metric labels: the first values seen keep their name, later ones share one."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.sources import add_source_details, or_else
from ..schemas import LABEL_CAPS, OVERFLOW_LABEL
from .sessions import correlate, session_rows
from .storage import stored

_BROADCAST_ROWS = 10_000  # a registry above this many rows is not broadcast by hint


@dataclass(frozen=True)
class LabelRegistry:
    """Values that keep their name, with the caps that bound how many there are."""

    rows: DataFrame  # dimension, value, display, position
    caps: dict[str, int] = field(default_factory=lambda: dict(LABEL_CAPS))

    def stored(self) -> LabelRegistry:
        """The registry computed now, once for all metrics that use it."""
        return LabelRegistry(stored(self.rows), self.caps)

    def small(self, lookup: DataFrame) -> DataFrame:
        """Broadcast hint for a lookup made of ``rows``, if the caps keep it small."""
        return F.broadcast(lookup) if sum(self.caps.values()) <= _BROADCAST_ROWS else lookup


def _cap_column(caps: dict[str, int]) -> Column:
    cap = F.lit(0)
    for dimension, n in caps.items():
        cap = F.when(F.col("dimension") == dimension, n).otherwise(cap)
    return cap


def _at(df: DataFrame, sub: int) -> Column:
    """Arrival order of a sighting; ``sub`` orders two sightings by one line."""
    if isinstance(df.schema["seq"].dataType, StructType):
        return F.struct(F.col("seq"), F.lit(sub).alias("sub"))
    return F.col("seq") * 2 + sub


def _sightings(rows: DataFrame, *labels) -> DataFrame:
    """Explodes (dimension, value, display, condition) label uses of each row."""
    uses = [
        F.when(used, F.struct(F.lit(d).alias("dimension"), value.alias("value"), display.alias("display")))
        for d, value, display, used in labels
    ]
    return (
        rows.select("at", F.explode(F.array(*uses)).alias("s"))
        .filter(F.col("s").isNotNull())
        .select("s.dimension", "s.value", "s.display", "at")
    )


def log_sightings(events: DataFrame, as_of, finished: DataFrame | None = None) -> DataFrame:
    """(dimension, value, display, at): every use of a label value by the log.

    A merged report of an invalid user repeats values its first report has used
    already, so all reports can be read without merging.  A finished session uses
    its own user's name just before the user of the closing line; the pairs are only
    needed where the two differ.  ``finished`` may bring ``session_rows`` made already.
    """
    kind = F.col("kind")
    seen = events.filter(
        kind.isin("accepted", "session_closed", "invalid_user", "failed_password", "max_auth", "preauth_closed")
    )
    enriched = "source_display" in events.columns
    display = F.col("source_display") if enriched else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    uses = _sightings(
        seen.withColumn("at", _at(seen, 1)),
        ("user", F.col("user"), none, kind != "preauth_closed"),
        ("source_ip", or_else(F.col("source_ip"), display), display, kind != "session_closed"),
        ("auth_method", F.col("auth_method"), none, kind == "accepted"),
    )
    if finished is None:
        finished = session_rows(correlate(events), as_of)
    pairs = finished.filter(
        (F.col("user") != F.col("close_user")) & (F.col("duration_seconds") >= 0)
    ).withColumnRenamed("close_seq", "seq")
    opened = _sightings(pairs.withColumn("at", _at(pairs, 0)), ("user", F.col("user"), none, F.lit(True)))
    return uses.unionByName(opened)


def snapshot_sightings(active: DataFrame, known_users: DataFrame | None = None) -> DataFrame:
    """Label uses of login snapshots: each session in turn, then the known users by name."""
    at = F.struct(
        F.col("snapshot_id").alias("snapshot"), F.col("line_no").alias("line"), F.lit("").alias("name")
    )
    none = F.lit(None).cast("string")
    uses = _sightings(
        active.withColumn("at", at),
        ("user", F.col("user"), none, F.lit(True)),
        ("source_ip", or_else(F.col("source_ip"), F.col("source_display")), F.col("source_display"), F.lit(True)),
    )
    if known_users is None:
        return uses
    first = active.agg(F.coalesce(F.min("snapshot_id"), F.lit("")).alias("s")).scalar()
    at = F.struct(first.alias("snapshot"), F.lit(2**63 - 1).alias("line"), F.col("user").alias("name"))
    return uses.unionByName(
        known_users.select(
            F.lit("user").alias("dimension"), F.col("user").alias("value"), none.alias("display"), at.alias("at")
        )
    )


def _ranked(first_seen: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The first ``caps[dimension]`` values of each dimension with their position.

    The first sightings are stored, as each dimension takes its own top rows of them; only
    those top rows, at most as many as the caps, are then numbered in a window.
    """
    first_seen = stored(first_seen)
    order = Window.partitionBy("dimension").orderBy("first", "value")
    tops = [first_seen.filter(F.col("dimension") == d).orderBy("first", "value").limit(n) for d, n in caps.items()]
    return reduce(DataFrame.unionByName, tops).withColumn("position", F.row_number().over(order))


def _earliest(sightings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at): the first sighting of each key in each block of its file or snapshot.

    A block's rows differ in one number only, whose minimum is taken by hashing; what is left are a
    few rows per key, whose compound orders can be compared.
    """
    order = sightings.schema["at"].dataType
    if not isinstance(order, StructType):
        return sightings.groupBy(*keys).agg(F.min("at").alias("at"))
    if "seq" in order.names:
        *outer, row = (f"at.seq.{n}" for n in order["seq"].dataType.names)
        number, behind = F.col(row) * 2 + F.col("at.sub"), []
    else:
        outer, number, behind = ["at.snapshot"], F.col("at.line"), ["at.name"]
    names = [f"_{k}" for k in range(len(outer) + len(behind))]
    flat = sightings.select(*keys, number.alias("_row"), *[F.col(c).alias(n) for c, n in zip(outer + behind, names)])
    firsts = flat.groupBy(*keys, *names).agg(F.min("_row").alias("_row"))
    at = F.struct(*names[: len(outer)], "_row", *names[len(outer) :])
    return firsts.select(*keys, at.alias("at"))


def _first_seen(sightings: DataFrame, with_display: bool) -> DataFrame:
    if not with_display:
        groups = _earliest(sightings, ["dimension", "value"]).groupBy("dimension", "value")
        return groups.agg(F.min("at").alias("first")).withColumn("display", F.lit(None).cast("string"))
    groups = _earliest(sightings, ["dimension", "value", "display"]).groupBy("dimension", "value")
    firsts = groups.agg(F.min(F.struct("at", "display")).alias("f"))
    return firsts.select("dimension", "value", F.col("f.at").alias("first"), F.col("f.display").alias("display"))


def _named(ranked: DataFrame) -> DataFrame:
    shown = F.coalesce("display", "source_display")
    return add_source_details(ranked, "value").select(
        "dimension", "value",
        F.when(F.col("dimension") == "source_ip", shown).otherwise("").alias("display"),
        "position",
    )


def registry_of(
    sightings: DataFrame, caps: dict[str, int] | None = None, with_display: bool = False
) -> LabelRegistry:
    caps = {**LABEL_CAPS, **(caps or {})}
    return LabelRegistry(_named(_ranked(_first_seen(sightings, with_display), caps)), caps)


def label_registry(events: DataFrame, as_of, caps: dict[str, int] | None = None) -> LabelRegistry:
    """Registry after a whole log; all metrics share it."""
    return registry_of(log_sightings(events, as_of), caps, "source_display" in events.columns)


def extend_registry(registry: LabelRegistry, sightings: DataFrame) -> LabelRegistry:
    """Registry after further sightings: free places go to new values in their order."""
    rows, caps = registry.rows, registry.caps
    known = registry.small(rows.select("dimension", "value"))
    fresh = sightings.join(known, ["dimension", "value"], "left_anti")
    taken = rows.groupBy("dimension").agg(F.max("position").alias("taken"))
    ranked = _named(_ranked(_first_seen(fresh, True), caps))
    added = ranked.join(F.broadcast(taken), "dimension", "left").withColumn(  # one row per dimension
        "position", F.col("position") + F.coalesce("taken", F.lit(0))
    )
    added = added.filter(F.col("position") <= _cap_column(caps))
    return LabelRegistry(rows.unionByName(added.select(rows.columns)), caps)


def pinned_displays(events: DataFrame, as_of) -> DataFrame:
    """(value, display): the name every source had at its first sighting, without a cap."""
    sources = log_sightings(events, as_of).filter(F.col("dimension") == "source_ip")
    return _named(_first_seen(sources, True).withColumn("position", F.lit(0))).select("value", "display")


def _lookups(registry: DataFrame) -> DataFrame:
    """One row per position with the value of each dimension at that position.

    The three lookups read this one table, so the log is read once for all of them.
    """
    def at(dimension: str, column: str) -> Column:
        return F.max(F.when(F.col("dimension") == dimension, F.col(column)))

    return registry.groupBy("position").agg(
        at("user", "value").alias("user"),
        at("source_ip", "value").alias("source_ip"),
        at("source_ip", "display").alias("source_display"),
        at("auth_method", "value").alias("auth_method"),
    )


def apply_labels(rows: DataFrame, registry: LabelRegistry | None) -> DataFrame:
    """Replaces the label columns of ``rows``; without a registry they stay as they are.

    Values outside the registry become ``__other__``; so does the display of such a
    source, while a registered source shows the name it had at its first sighting.
    """
    if registry is None:
        return rows
    wide = _lookups(registry.rows)
    other = F.lit(OVERFLOW_LABEL)
    for name in ("user", "auth_method"):
        if name in rows.columns:
            known = wide.select(F.col(name).alias("_known")).filter(F.col("_known").isNotNull())
            rows = rows.join(registry.small(known), F.col(name) == F.col("_known"), "left")
            rows = rows.withColumn(name, F.coalesce("_known", other)).drop("_known")
    if "source_ip" in rows.columns:
        known = wide.select(
            F.col("source_ip").alias("_known"), F.col("source_display").alias("_shown")
        ).filter(F.col("_known").isNotNull())
        key = F.col("source_ip")
        if "source_display" in rows.columns:
            key = or_else(key, F.col("source_display"))
        rows = rows.join(registry.small(known), key == F.col("_known"), "left")
        rows = rows.withColumns(
            {"source_ip": F.coalesce("_known", other), "source_display": F.coalesce("_shown", other)}
        ).drop("_known", "_shown")
    return rows
