"""Declared schemas: captured frames in, packet features out."""

from __future__ import annotations

from pyspark.sql import types as T

FRAME_SCHEMA = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("packet_no", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("linktype", T.IntegerType()),
        T.StructField("frame", T.BinaryType()),
    ]
)

# The names and types of the packet feature columns.
FEATURES = [
    ("timestamp", T.DoubleType()),
    ("length", T.IntegerType()),
    ("inter_arrival_time", T.DoubleType()),
    ("ip_proto_number", T.IntegerType()),
    ("ip_ttl", T.IntegerType()),
    ("ip_id", T.IntegerType()),
    ("ip_flags_df", T.IntegerType()),
    ("ip_flags_mf", T.IntegerType()),
    ("wrong_fragment", T.IntegerType()),
    ("tcp_sport", T.IntegerType()),
    ("tcp_dport", T.IntegerType()),
    ("tcp_seq", T.LongType()),
    ("tcp_ack", T.LongType()),
    ("tcp_flag_int", T.IntegerType()),
    ("tcp_flag_syn", T.IntegerType()),
    ("tcp_flag_ack", T.IntegerType()),
    ("tcp_flag_fin", T.IntegerType()),
    ("tcp_flag_rst", T.IntegerType()),
    ("tcp_flag_psh", T.IntegerType()),
    ("tcp_flag_urg", T.IntegerType()),
    ("urgent_pointer", T.IntegerType()),
    ("tcp_window", T.IntegerType()),
    ("tcp_dataofs", T.IntegerType()),
    ("udp_sport", T.IntegerType()),
    ("udp_dport", T.IntegerType()),
    ("udp_len", T.IntegerType()),
    ("icmp_type", T.IntegerType()),
    ("icmp_code", T.IntegerType()),
    ("payload_size", T.IntegerType()),
    ("is_empty_payload", T.IntegerType()),
]

FEATURE_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in FEATURES])

FEATURE_COLUMNS = FEATURE_SCHEMA.names
LABEL = "label"


def feature_columns(columns: list[str], label: str = LABEL, exclude: tuple[str, ...] = ()) -> list[str]:
    """Every column except the label and the excluded ones, in their given order."""
    return [c for c in columns if c != label and c not in exclude]
