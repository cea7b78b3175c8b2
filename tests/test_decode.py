from __future__ import annotations

import pytest
from packets import MACS, ethernet, ip4, ip6, tcp, udp

from packetloom.functions.headers import decode_frames, summarize_packets, summary_line
from packetloom.plans.extract import extract_features
from packetloom.schema import FEATURE_COLUMNS, FEATURE_SCHEMA, FRAME_SCHEMA

FRAMES = {
    "tcp": (1, ethernet(0x0800, ip4(6, tcp(payload=b"x" * 20)))),
    "tcp_options": (1, ethernet(0x0800, ip4(6, tcp(payload=b"xyz", words=8), options=b"\1" * 8))),
    "vlan": (1, ethernet(0x0800, ip4(6, tcp()), tags=1)),
    "vlan2": (1, ethernet(0x0800, ip4(6, tcp()), tags=2)),
    "udp": (1, ethernet(0x0800, ip4(17, udp()) + b"\0" * 14)),
    "icmp": (1, ethernet(0x0800, ip4(1, bytes([8, 3]) + b"\0" * 6 + b"pp"))),
    "first_fragment": (1, ethernet(0x0800, ip4(17, udp(), flags=0x2000))),
    "later_fragment": (1, ethernet(0x0800, ip4(17, b"datadata", flags=0x2000 | 100))),
    "unknown": (1, ethernet(0x0800, ip4(253, b"abc"))),
    "arp": (1, ethernet(0x0806, b"\0" * 28)),
    "lldp": (1, ethernet(0x88CC, b"\1" * 9)),
    "ipv6_tcp": (1, ethernet(0x86DD, ip6(6, tcp(payload=b"12345")))),
    "ipv6_options": (1, ethernet(0x86DD, ip6(0, bytes([60, 0]) + b"\0" * 6 + bytes([17, 1]) + b"\0" * 14 + udp()))),
    "ipv6_fragment": (1, ethernet(0x86DD, ip6(44, bytes([17, 0, 0, 9, 0, 0, 0, 1]) + b"tail"))),
    "raw4": (101, ip4(6, tcp())),
    "raw6": (101, ip6(17, udp())),
    "loopback": (0, b"\2\0\0\0" + ip4(17, udp())),
    "cooked": (113, b"\0" * 14 + b"\x08\x00" + ip4(6, tcp())),
    "cut_ip": (1, ethernet(0x0800, ip4(6, tcp()))[:24]),
    "cut_tcp": (1, ethernet(0x0800, ip4(6, tcp()))[:47]),
    "cut_link": (1, b"\1\2\3"),
    "empty": (1, b""),
    "joined": (1, ethernet(0x0800, ip4(6, tcp(payload=b"z" * 9), length=0))),
}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(name, i, i * 1_000_000, link, bytearray(data)) for i, (name, (link, data)) in enumerate(FRAMES.items())]
    return spark.createDataFrame(rows, FRAME_SCHEMA)


@pytest.fixture(scope="module")
def decoded(frames):
    return {r.capture_id: r for r in decode_frames(frames).collect()}


def test_schema(frames):
    out = decode_frames(frames)
    assert out.columns == ["capture_id", "packet_no", "ts_us", *FEATURE_COLUMNS]
    assert len(FEATURE_COLUMNS) == 30
    assert [f.dataType for f in out.schema][3:] == [f.dataType for f in FEATURE_SCHEMA]


def test_tcp_fields(decoded):
    r = decoded["tcp"]
    assert (r.ip_proto_number, r.ip_ttl, r.ip_id, r.ip_flags_df, r.ip_flags_mf, r.wrong_fragment) == (6, 64, 7238, 1, 0, 0)
    assert (r.tcp_sport, r.tcp_dport, r.tcp_seq, r.tcp_ack) == (54321, 80, 4294967295, 2)
    assert (r.tcp_flag_int, r.tcp_flag_syn, r.tcp_flag_ack, r.tcp_flag_fin, r.tcp_flag_rst) == (18, 1, 1, 0, 0)
    assert (r.tcp_window, r.urgent_pointer, r.tcp_dataofs) == (4095, 7, 5)
    assert (r.payload_size, r.is_empty_payload, r.length) == (20, 0, 74)
    assert (r.udp_sport, r.icmp_type) == (None, None)
    assert decoded["tcp_options"].payload_size == 3 and decoded["tcp_options"].tcp_dataofs == 8


@pytest.mark.parametrize("name", ["vlan", "vlan2", "raw4", "cooked"])
def test_other_links(decoded, name):
    r = decoded[name]
    assert (r.ip_proto_number, r.tcp_sport, r.payload_size, r.is_empty_payload) == (6, 54321, 0, 1)


def test_udp_and_icmp(decoded):
    r = decoded["udp"]
    assert (r.udp_sport, r.udp_dport, r.udp_len, r.payload_size) == (5000, 53, 12, 4)
    assert (r.tcp_sport, r.tcp_flag_int, r.urgent_pointer) == (None, 0, 0)
    assert decoded["loopback"].udp_dport == 53
    r = decoded["icmp"]
    assert (r.icmp_type, r.icmp_code, r.payload_size) == (8, 3, 2)


def test_fragments(decoded):
    r = decoded["first_fragment"]
    assert (r.ip_flags_mf, r.wrong_fragment, r.udp_sport) == (1, 0, 5000)
    r = decoded["later_fragment"]
    assert (r.wrong_fragment, r.udp_sport, r.payload_size) == (1, None, 8)


def test_ipv6_fills_transport_only(decoded):
    r = decoded["ipv6_tcp"]
    assert (r.ip_proto_number, r.ip_ttl, r.tcp_dport, r.payload_size) == (None, None, 80, 5)
    assert decoded["ipv6_options"].udp_dport == 53 and decoded["ipv6_options"].payload_size == 4
    assert decoded["ipv6_fragment"].udp_dport is None and decoded["ipv6_fragment"].payload_size == 4
    assert decoded["raw6"].udp_sport == 5000


def test_malformed_rows_are_kept(decoded):
    assert len(decoded) == len(FRAMES)
    r = decoded["cut_ip"]
    assert (r.ip_ttl, r.ip_proto_number, r.tcp_sport, r.ip_flags_df) == (64, 6, None, 1)
    r = decoded["cut_tcp"]
    assert (r.tcp_sport, r.tcp_seq, r.tcp_dataofs, r.tcp_window) == (54321, 4294967295, 5, None)
    for name in ("cut_link", "empty", "arp"):
        r = decoded[name]
        assert (r.ip_proto_number, r.payload_size, r.is_empty_payload) == (None, 0, 1)
    assert decoded["lldp"].payload_size == 9
    assert decoded["joined"].payload_size == 9


def test_features_are_clean_and_filterable(frames):
    out = extract_features(frames, label=1, keep=("capture_id",))
    assert out.columns == ["capture_id", *FEATURE_COLUMNS, "label"]
    rows = out.collect()
    assert len(rows) == len(FRAMES) and all(v is not None for r in rows for v in r)
    assert {r.label for r in rows} == {1}
    assert out.filter("tcp_sport = 54321 and payload_size = 20").count() == 1


def test_summary(frames):
    rows = {r.capture_id: r for r in summarize_packets(frames).collect()}
    assert (rows["tcp"].src, rows["tcp"].dst, rows["tcp"].protocol) == ("172.16.10.99", "192.168.0.7", "tcp")
    assert rows["unknown"].protocol == "IP#253"
    assert (rows["arp"].src, rows["arp"].dst, rows["arp"].protocol) == ("11:22:33:44:55:66", "aa:bb:cc:dd:ee:ff", "Ethernet")
    assert (rows["raw6"].src, rows["raw6"].dst, rows["raw6"].protocol) == ("2001:db8::1", "fe80::f", "IPv6")
    assert rows["empty"].src == "unknown" and rows["cooked"].protocol == "tcp"
    line = summarize_packets(frames.filter("capture_id = 'udp'")).select(summary_line()).first()[0]
    assert line == "Packet: 172.16.10.99 → 192.168.0.7 | Protocol: udp | Length: 60"
    named = summarize_packets(frames.filter("capture_id = 'unknown'"), {253: "lab"}).first()
    assert named.protocol == "lab"


LONG_OPTIONS = bytes([6, 25]) + b"\0" * 206
DEEP = {
    "ipv6_208_octets": (1, ethernet(0x86DD, ip6(0, LONG_OPTIONS + tcp(1234, 80, flags=24, payload=b"0123456789")))),
    "vlan_stack": (1, ethernet(0x0800, ip4(6, tcp(1234, 80, flags=24, payload=b"0123456789")), tags=80)),
    "ip_in_ip": (1, ethernet(0x0800, ip4(4, ip4(6, tcp(1234, 80, flags=24, payload=b"0123456789"), ttl=9)))),
    "6in4": (1, ethernet(0x0800, ip4(41, ip6(6, tcp(1234, 80, flags=24, payload=b"0123456789"))))),
    "4in6": (1, ethernet(0x86DD, ip6(4, ip4(6, tcp(1234, 80, flags=24, payload=b"0123456789"))))),
    "gre": (1, ethernet(0x0800, ip4(47, b"\x20\x00\x08\x00" + b"\0\0\0\7" + ip4(6, tcp(1234, 80, flags=24, payload=b"0123456789"))))),
    "snap": (1, MACS + b"\x00\x60\xaa\xaa\x03\x00\x00\x00\x08\x00" + ip4(6, tcp(1234, 80, flags=24, payload=b"0123456789"))),
}


def test_long_and_nested_headers_are_read(spark):
    rows = [(name, i, 0, link, bytearray(data)) for i, (name, (link, data)) in enumerate(DEEP.items())]
    found = {r.capture_id: r for r in decode_frames(spark.createDataFrame(rows, FRAME_SCHEMA)).collect()}
    for name, row in found.items():
        assert (row.tcp_sport, row.tcp_dport, row.tcp_flag_int, row.payload_size, row.is_empty_payload) == (1234, 80, 24, 10, 0), name
    assert (found["ip_in_ip"].ip_proto_number, found["ip_in_ip"].ip_ttl) == (4, 64)
    assert (found["6in4"].ip_proto_number, found["4in6"].ip_proto_number) == (41, 6)


def test_deep_tags_cost_the_other_frames_nothing(spark):
    import numpy as np
    import pyarrow as pa

    from packetloom.functions import headers

    def reads(tags):
        calls = []

        class Counted(headers._Heads):
            def read(self, at, width):
                calls.append(len(at))
                return super().read(at, width)

        body = bytes.fromhex("0800") + bytes.fromhex("4500003200010000400600000A0000010A000002") + bytes(30)
        frames = [bytes(12) + bytes.fromhex("81000005") * n + body for n in (tags, *[0] * 40)]
        size = np.array([len(f) for f in frames])
        found = headers._read_headers(Counted(pa.array(frames, pa.binary()), size), size, np.ones(41, np.int64))
        assert found["ip_proto_number"].tolist() == [6] * 41 and found["l3_offset"].tolist() == [14 + 4 * tags] + [14] * 40
        return sum(calls)

    assert reads(50) == reads(0)
