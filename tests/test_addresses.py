from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from packetloom.functions.octets import ipv4_text, ipv6_groups, ipv6_text, mac_text


def test_ipv6_text_is_canonical(spark):
    draw = random.Random(4)
    addresses = [bytes(draw.choice([0, 0, 0, 1, 255]) for _ in range(16)) for _ in range(300)]
    addresses += [bytes(16), b"\0" * 15 + b"\1", b"\1" + b"\0" * 15, b"\x20\x01\x0d\xb8" + b"\0" * 4 + b"\0\1" + b"\0" * 4 + b"\0\1"]
    df = spark.createDataFrame([(bytearray(a),) for a in addresses], "a BINARY")
    df = df.withColumn("g", ipv6_groups(F.col("a")))
    found = df.select("a", ipv6_text(F.col("g")).alias("t")).collect()
    for r in found:
        wanted = ipaddress.IPv6Address(bytes(r.a))
        assert ipaddress.IPv6Address(r.t) == wanted
        assert r.t == str(wanted)


def test_short_addresses(spark):
    df = spark.createDataFrame([(bytearray([10, 0, 255, 1]), bytearray([0, 17, 170, 187, 204, 255]))], "a BINARY, m BINARY")
    row = df.select(ipv4_text(F.col("a")).alias("a"), mac_text(F.col("m")).alias("m")).first()
    assert (row.a, row.m) == ("10.0.255.1", "00:11:aa:bb:cc:ff")
