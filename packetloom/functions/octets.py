"""Addresses out of a binary column with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def octets_at(data: Column, size: Column, offset: Column | int, octets: int) -> Column:
    """Bytes at a zero-based ``offset``; NULL when cut short."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.when(size >= offset + octets, F.substring(data, offset + 1, F.lit(octets)))


def ipv4_text(address: Column) -> Column:
    """Dotted text of a four-byte address."""
    return F.concat_ws(".", *[F.conv(F.hex(F.substring(address, i, 1)), 16, 10) for i in range(1, 5)])


def mac_text(address: Column) -> Column:
    """Colon-separated lower-case hex of a six-byte link address."""
    return F.lower(F.concat_ws(":", *[F.hex(F.substring(address, i, 1)) for i in range(1, 7)]))


def ipv6_groups(address: Column) -> Column:
    """The eight hex groups of a 16-byte address, without leading zeros."""
    groups = [F.conv(F.hex(F.substring(address, i, 2)), 16, 16) for i in range(1, 17, 2)]
    return F.lower(F.concat_ws(":", *groups))


def ipv6_text(groups: Column) -> Column:
    """Canonical text: the longest run of zero groups, the first of equals, becomes ``::``."""
    runs = F.regexp_extract_all(groups, F.lit(r"(?:^|:)0(?::0)+(?![0-9a-f])"), F.lit(0))

    def shortened(run: Column) -> Column:
        at = F.position(run, groups)
        rest = F.ltrim(groups.substr(at + F.length(run), F.length(groups)), F.lit(":"))
        zeros = F.length(F.replace(run, F.lit(":"), F.lit("")))
        return F.struct(zeros, -at, F.concat(groups.substr(F.lit(1), at - 1), F.lit("::"), rest).alias("text"))

    return F.coalesce(F.array_max(F.transform(runs, shortened))["text"], groups)
