"""Host names of addresses, joined from a table of reverse-DNS lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.sources import add_source_details
from ..schemas import HOSTNAME_TTL_SECONDS, NO_HOSTNAME_TTL_SECONDS
from .chunks import following


def latest_hostnames(ptr: DataFrame) -> DataFrame:
    """(ip, ptr_hostname): the newest lookup of each address."""
    newest = F.max(F.struct("resolved_at", "hostname"))
    return ptr.groupBy("ip").agg(newest.alias("newest")).select(
        "ip", F.col("newest.hostname").alias("ptr_hostname")
    )


def _with_hostname(rows: DataFrame) -> DataFrame:
    return add_source_details(rows, "source_ip", "ptr_hostname").drop("ptr_hostname", "ip")


def enrich_hosts(rows: DataFrame, ptr: DataFrame) -> DataFrame:
    """Sets source_hostname and source_display from the newest lookup of source_ip.

    The size of the lookup table is not known here, so Spark chooses the join; a hot
    address is split by adaptive skew handling, as only the left side is large.
    """
    names = latest_hostnames(ptr)
    return _with_hostname(rows.join(names, rows.source_ip == names.ip, "left"))


def lookup_intervals(
    ptr: DataFrame,
    ttl: int = HOSTNAME_TTL_SECONDS,
    negative_ttl: int = NO_HOSTNAME_TTL_SECONDS,
) -> DataFrame:
    """(ip, hostname, valid_from, valid_to): a lookup holds until it expires or is replaced."""
    one = ptr.groupBy("ip", "resolved_at").agg(F.max("hostname").alias("hostname"))
    day = F.date_trunc("day", F.col("resolved_at"))
    rows = following(one, "ip", "resolved_at", F.col("resolved_at"), "replaced_at", day)
    lifetime = F.when(F.col("hostname") == "", negative_ttl).otherwise(ttl)
    expires = F.timestamp_add("SECOND", lifetime, F.col("resolved_at"))
    return rows.select(
        "ip", "hostname",
        F.col("resolved_at").alias("valid_from"),
        F.least(expires, "replaced_at").alias("valid_to"),
    )


def enrich_hosts_ttl(
    rows: DataFrame,
    ptr: DataFrame,
    ttl: int = HOSTNAME_TTL_SECONDS,
    negative_ttl: int = NO_HOSTNAME_TTL_SECONDS,
    ts: str = "ts",
) -> DataFrame:
    """As ``enrich_hosts`` with the lookup that was valid at the row's time.

    Validity intervals of an address do not overlap, so a row meets one at most and
    nothing is aggregated afterwards.  Intervals are spread over the time slots they
    touch (two at most, a slot being one lifetime), which keeps the join an equi-join.
    """
    width = max(ttl, negative_ttl, 1)

    def slot(moment):
        return F.floor(F.unix_timestamp(moment.cast("timestamp")) / width)

    spans = lookup_intervals(ptr, ttl, negative_ttl).withColumn(
        "slot", F.explode(F.sequence(slot(F.col("valid_from")), slot(F.col("valid_to"))))
    )
    rows = rows.withColumn("_slot", slot(F.col(ts)))
    match = (
        (rows["source_ip"] == spans["ip"])
        & (rows["_slot"] == spans["slot"])
        & (rows[ts] >= spans["valid_from"])
        & (rows[ts] < spans["valid_to"])
    )
    found = rows.join(spans, match, "left").withColumn("ptr_hostname", F.col("hostname"))
    return _with_hostname(found.drop("_slot", "slot", "valid_from", "valid_to", "hostname"))
