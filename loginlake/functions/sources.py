"""What a source token (address or host name) means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _v6_pattern() -> str:
    """Every written form of an IPv6 address: full, shortened, with an IPv4 tail, with a zone."""
    h = "[0-9A-Fa-f]{1,4}"
    forms = [rf"{h}(?::{h}){{7}}", rf"(?:{h}:){{6}}{_V4}"]
    for left in range(8):
        head = rf"{h}(?::{h}){{{left - 1}}}" if left else ""
        room = 7 - left
        tail = rf"(?:{h}(?::{h}){{0,{room - 1}}})?" if room else ""
        forms.append(f"{head}::{tail}")
        if left <= 5:
            forms.append(rf"{head}::(?:{h}:){{0,{5 - left}}}{_V4}")
    return rf"^(?:{'|'.join(forms)})(?:%[^%/]+)?$"


_V6_PATTERN = _v6_pattern()


def is_ip_address(token: str) -> str:
    """SQL condition: the text of column ``token`` is an IP address."""
    return (
        f"CASE WHEN contains({token}, ':') THEN {token} RLIKE r'{_V6_PATTERN}'"
        f" ELSE {token} RLIKE r'^{_V4}$' END"
    )


def or_else(text: Column, *others: Column) -> Column:
    """First of the texts that is neither NULL nor empty, else ''."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in (text, *others)], F.lit(""))


def add_source_details(rows: DataFrame, source: str, ptr_hostname: str | None = None) -> DataFrame:
    """Adds source_ip, source_hostname and source_display of the raw token in ``source``.

    ``ptr_hostname`` names the column with the looked-up name of the address, if
    there is one; it is ignored when it only repeats the address, or for host names.
    """
    def host_name(text: str) -> str:
        trimmed = rf"regexp_replace({text}, r'(?U)^\s+|\s+$', '')"
        return rf"lower(regexp_replace({trimmed}, r'\.+$', ''))"

    token = rf"regexp_replace(coalesce({source}, ''), r'(?U)^\s+|\s+$', '')"
    by_name = host_name("_token")
    if ptr_hostname is None:
        hostname = f"CASE WHEN _is_ip THEN '' ELSE {by_name} END"
    else:
        hostname = f"CASE WHEN _is_ip THEN {host_name(ptr_hostname)} ELSE {by_name} END"
    named = rows.withColumn("_token", F.expr(token)).withColumn("_is_ip", F.expr(is_ip_address("_token")))
    named = named.withColumn("_name", F.expr(f"coalesce({hostname}, '')"))
    if ptr_hostname is None:
        display = "CASE WHEN _name = '' THEN _token ELSE _name END"
    else:
        named = named.withColumn("_name", F.expr("CASE WHEN _is_ip AND _name = _token THEN '' ELSE _name END"))
        display = (
            "CASE WHEN _name = '' THEN _token"
            " WHEN _is_ip THEN concat(_name, ' (', _token, ')') ELSE _name END"
        )
    return named.withColumns(
        {
            "source_ip": F.col("_token"),
            "source_hostname": F.col("_name"),
            "source_display": F.expr(display),
        }
    ).drop("_token", "_is_ip", "_name")


def is_remote(source: str) -> Column:
    """Sessions from elsewhere: not local terminals, multiplexers or X displays."""
    return F.expr(
        rf"{source} <> '' AND NOT startswith({source}, 'tmux') AND NOT {source} RLIKE r'^:\d+(?:\.\d+)?$'"
    )
