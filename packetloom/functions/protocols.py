"""IP protocol numbers and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Number and name of IP protocols as in the common /etc/protocols file.
IP_PROTOCOLS = {
    0: "ip", 1: "icmp", 2: "igmp", 3: "ggp", 4: "ipencap", 5: "st", 6: "tcp", 8: "egp", 9: "igp",
    12: "pup", 17: "udp", 20: "hmp", 22: "xns-idp", 27: "rdp", 29: "iso-tp4", 33: "dccp", 36: "xtp",
    37: "ddp", 38: "idpr-cmtp", 41: "ipv6", 43: "ipv6-route", 44: "ipv6-frag", 45: "idrp", 46: "rsvp",
    47: "gre", 50: "esp", 51: "ah", 57: "skip", 58: "ipv6-icmp", 59: "ipv6-nonxt", 60: "ipv6-opts",
    73: "rspf", 81: "vmtp", 88: "eigrp", 89: "ospf", 93: "ax.25", 94: "ipip", 97: "etherip", 98: "encap",
    103: "pim", 108: "ipcomp", 112: "vrrp", 115: "l2tp", 124: "isis", 132: "sctp", 133: "fc",
    135: "mobility-header", 136: "udplite", 137: "mpls-in-ip", 138: "manet", 139: "hip", 140: "shim6",
    141: "wesp", 142: "rohc", 143: "ethernet",
}


def protocol_table(spark: SparkSession, names: dict[int, str] | None = None) -> DataFrame:
    """``(proto, proto_name)``; at most 256 rows, since the field is one byte."""
    rows = [(number, name) for number, name in (names or IP_PROTOCOLS).items() if 0 <= number <= 255]
    return spark.createDataFrame(rows, "proto INT, proto_name STRING")
