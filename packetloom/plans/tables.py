"""Views of the shared test tables as the inputs that the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.quantiles import exact_percentile
from packetloom.operators.scaling import Scaler, fit_scaler, mean_square

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_FEATURES = ["o_totalprice", "o_custkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(timestamp: str) -> Column:
    """A zone-less time as microseconds since the epoch, read as UTC in any session zone."""
    at = F.col(timestamp)
    days = F.unix_date(at.cast("date")).cast("long")
    minutes = (days * 24 + F.hour(at)) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.withColumn("label", (F.col("l_returnflag") == "R").cast("int"))


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", *ORDER_FEATURES, (F.col("o_orderstatus") == "F").cast("int").alias("label"))


def six_places(value: Column) -> Column:
    """Rounds a score so that engines agree on it; plain arithmetic, cheaper than ``round``."""
    return F.floor(value * 1e6 + 0.5) / 1e6


def distance(scaler: Scaler) -> Column:
    """Mean squared z-score of a row."""
    return six_places(mean_square(scaler.scaled()))


def scored_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    """Lines with label, score and the prediction at the 95th percentile, and that threshold."""
    lines = labelled_lines(spark, sf_dir)
    scored = lines.withColumn("score", distance(fit_scaler(lines, LINE_FEATURES)))
    threshold = exact_percentile(scored, "score", 0.95)
    return scored.withColumn("prediction", (F.col("score") > F.lit(threshold)).cast("int")), threshold


def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with ``mse`` and ``mae`` of the scaled features against zero."""
    lines = labelled_lines(spark, sf_dir)
    scaler = fit_scaler(lines, LINE_FEATURES)
    absolute = [F.abs(c) for c in scaler.scaled()]
    mae = sum(absolute[1:], absolute[0]) / len(absolute)
    return lines.select("label", distance(scaler).alias("mse"), six_places(mae).alias("mae"))


def hex_field(value: Column, digits: int) -> Column:
    """A number as fixed-width hex text."""
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def line_frames(spark: SparkSession, sf_dir: str, cut: bool) -> DataFrame:
    """One Ethernet frame per line, its header fields taken from the integer columns.

    The line number picks TCP, UDP, ICMP, an unknown protocol, VLAN-tagged TCP or ARP; with
    ``cut`` the frames of every seventh order are truncated.
    """
    order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    number, payload = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    zeros = F.repeat(F.lit("00"), payload)
    tcp = F.concat(
        hex_field(1024 + order % 60000, 4), hex_field(part % 1024, 4),
        hex_field(order * 65537 % 4294967296, 8), hex_field(part * 99991 % 4294967296, 8),
        F.lit("50"), hex_field(payload % 64, 2), hex_field(part % 65536, 4), F.lit("0000"), hex_field(supplier % 3, 4),
    )
    udp = F.concat(hex_field(1024 + order % 60000, 4), hex_field(part % 1024, 4), hex_field(8 + payload, 4), F.lit("0000"))
    icmp = F.concat(hex_field(supplier % 20, 2), hex_field(payload % 16, 2), F.lit("000000000000"))
    transport = F.when(number.isin(1, 2, 6), tcp).when(number == 3, udp).when(number == 4, icmp).otherwise("")
    protocol = F.when(number.isin(1, 2, 6), 6).when(number == 3, 17).when(number == 4, 1).otherwise(253)
    fragment = order % 2 * 16384 + part % 2 * 8192 + F.when(part % 11 == 0, 185).otherwise(0)
    ip = F.concat(
        F.lit("4500"), hex_field(20 + F.length(transport) / 2 + payload, 4), hex_field(order % 65536, 4), hex_field(fragment, 4),
        hex_field(32 + supplier % 200, 2), hex_field(protocol, 2), F.lit("0000"),
        F.lit("0A"), hex_field(supplier % 256, 2), hex_field(part % 256, 2), F.lit("01"),
        F.lit("C0A8"), hex_field(order % 256, 2), F.lit("02"),
    )
    ether = (
        F.when(number == 6, F.concat(F.lit("8100"), hex_field(supplier % 4096, 4), F.lit("0800")))
        .when(number == 7, "0806")
        .otherwise("0800")
    )
    body = F.when(number == 7, F.repeat(F.lit("00"), F.lit(28))).otherwise(F.concat(ip, transport, zeros))
    text = F.concat(hex_field(supplier % 65536, 12), hex_field(part % 65536, 12), ether, body)
    if cut:
        short = F.substring(text, F.lit(1), (part % 64 * 2).cast("int"))
        text = F.when(order % 7 == 0, short).otherwise(text)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(0).cast("long").alias("ts_us"), F.lit(1).alias("linktype"), F.unhex(text).alias("frame")
    )


def line_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored lines with the columns that an alert is made of."""
    scored, _ = scored_lines(spark, sf_dir)
    order, part, number = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    tcp = number.isin(1, 2, 6)
    seconds = (micros("l_shipdate") / 1_000_000).cast("long")
    return scored.select(
        "l_orderkey",
        "l_linenumber",
        F.when(tcp, order % 5 * 1000).alias("tcp_sport"),
        F.when(tcp, part % 1024).alias("tcp_dport"),
        F.when(tcp | (number == 3), order % 60000).alias("udp_sport"),
        F.when(number == 3, part % 1024).alias("udp_dport"),
        F.when(number < 7, number + 5).alias("ip_proto_number"),
        F.col("score").alias("anomaly_score"),
        F.when(number == 5, 0).when(number < 7, seconds).alias("timestamp"),
        "prediction",
    )


def long_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP frames behind up to 89 VLAN tags (odd orders) or an IPv6 extension header of up to 512 bytes."""
    order, part, supplier = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    payload = F.col("l_quantity").cast("int")
    tcp = F.concat(
        hex_field(1024 + order % 60000, 4), hex_field(part % 1024, 4), F.lit("0000000100000002"),
        F.lit("50"), hex_field(payload % 64, 2), F.lit("0FFF00000000"),
    )
    zeros = F.repeat(F.lit("00"), payload)
    tags = (part % 90).cast("int")
    ip4 = F.concat(F.lit("4500"), hex_field(40 + payload, 4), F.lit("0001000040060000"), F.lit("0A0000010A000002"), tcp)
    units = (part % 64).cast("int")
    ip6 = F.concat(
        F.lit("60000000"), hex_field(8 * (units + 1) + 20 + payload, 4), F.lit("0040"), F.repeat(F.lit("11"), F.lit(32)),
        F.lit("06"), hex_field(units, 2), F.repeat(F.lit("00"), 8 * (units + 1) - 2), tcp,
    )
    tagged = F.concat(F.repeat(F.lit("81000005"), tags), F.lit("0800"), ip4, zeros)
    text = F.concat(F.repeat(F.lit("AB"), F.lit(12)), F.when(order % 2 == 1, tagged).otherwise(F.concat(F.lit("86DD"), ip6, zeros)))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit(0).cast("long").alias("ts_us"), F.lit(1).alias("linktype"), F.unhex(text).alias("frame")
    )
