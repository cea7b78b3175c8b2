"""Packet header fields of binary frames.

Offsets are those of the public RFCs.  Every read is guarded by the captured length, so a
truncated or odd frame yields NULL fields and keeps its row.

The headers are read by one vectorised Arrow function over the first bytes of the frames.
As column expressions the same reads are some forty guarded slices whose offsets depend on
each other: they outgrow a generated method, and a filter above them makes the planner
substitute definitions through all steps without end.  A function column is opaque to both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.octets import ipv4_text, ipv6_groups, ipv6_text, mac_text, octets_at
from packetloom.functions.protocols import protocol_table
from packetloom.schema import FEATURE_SCHEMA

# Link types, EtherTypes and IP protocol numbers.
LINK_NULL, LINK_ETHERNET, LINK_LOOP, LINK_COOKED, LINK_COOKED2 = 0, 1, 108, 113, 276
LINK_RAW = (12, 14, 101, 228, 229)
ETHERTYPE_IPV4, ETHERTYPE_IPV6, ETHERTYPE_ARP = 0x0800, 0x86DD, 0x0806
ETHERTYPES_VLAN = (0x8100, 0x88A8)
ICMP, TCP, UDP = 1, 6, 17
IPV6_OPTION_HEADERS, IPV6_FRAGMENT, IPV6_AUTH = (0, 43, 60), 44, 51

IN_IPV4, IN_IPV6, GRE = 4, 41, 47

# Most frames need no more than these bytes; those that do are read again as a whole.
HEAD_OCTETS = 256

_OF_FRAME = ("timestamp", "length", "inter_arrival_time")
HEADER_SCHEMA = T.StructType(
    [f for f in FEATURE_SCHEMA if f.name not in _OF_FRAME]
    + [T.StructField(n, T.IntegerType()) for n in ("l3_offset", "ip_version", "ran_out")]
)


class _Heads:
    """Byte columns of a batch of frame heads, and which rows asked for bytes that only the whole frame has."""

    def __init__(self, heads: pa.Array, whole: np.ndarray):
        heads = heads.cast(pa.large_binary())
        if heads.null_count:
            heads = heads.fill_null(b"")
        _, offsets, data = heads.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[heads.offset : heads.offset + len(heads) + 1]
        octets = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.starts, self.sizes = bounds[:-1], np.diff(bounds)
        self.octets = np.append(octets, np.uint8(0))
        self.none = np.zeros(len(heads), dtype=bool)
        self.whole, self.ran_out = whole, self.none.copy()

    def read(self, at: np.ndarray, width: int) -> np.ma.MaskedArray:
        """Big-endian integers at per-row offsets; masked where the head is cut short."""
        at = np.ma.asarray(at)
        asked = ~np.ma.getmaskarray(at)
        short = ~asked | (at.filled(0) + width > self.sizes)
        self.ran_out |= asked & short & (at.filled(0) + width <= self.whole)
        begin = np.where(short, 0, self.starts + at.filled(0))
        value = np.zeros(len(begin), dtype=np.int64)
        for i in range(width):
            value = value << 8 | self.octets[np.minimum(begin + i, len(self.octets) - 1)]
        return np.ma.array(value, mask=short)


def _where(condition: np.ndarray, value: np.ma.MaskedArray) -> np.ma.MaskedArray:
    """The value where the condition holds, masked elsewhere."""
    return np.ma.array(value.data, mask=np.ma.getmaskarray(value) | ~condition)


def _holds(condition: np.ma.MaskedArray) -> np.ndarray:
    return np.ma.filled(condition, False)


def _either(condition: np.ndarray, first: np.ma.MaskedArray, second: np.ma.MaskedArray) -> np.ma.MaskedArray:
    """The first value where the condition holds, the second elsewhere."""
    mask = np.where(condition, np.ma.getmaskarray(first), np.ma.getmaskarray(second))
    return np.ma.array(np.where(condition, np.ma.getdata(first), np.ma.getdata(second)), mask=mask)


def _stepped(heads: _Heads, where: np.ndarray, base: np.ma.MaskedArray, ether: np.ma.MaskedArray, octets: int):
    """Base and EtherType behind a tag of ``octets`` that ends in the type of what follows."""
    base = np.ma.array(np.where(where, base.data + octets, base.data), mask=np.ma.getmaskarray(base))
    return base, _either(where, heads.read(_where(where, base) - 2, 2), ether)


def _behind_tags(heads: _Heads, base: np.ma.MaskedArray, ether: np.ma.MaskedArray):
    """Base and EtherType behind all VLAN tags; every turn looks only at the frames that have one more."""
    bases, kinds, cut = base.data.copy(), ether.filled(0), np.ma.getmaskarray(ether).copy()
    rows = np.flatnonzero(np.isin(kinds, ETHERTYPES_VLAN))
    while len(rows):
        at = bases[rows] + 4
        there = at <= heads.sizes[rows]
        begin = np.where(there, heads.starts[rows] + at - 2, 0)
        kind = np.where(there, heads.octets[begin].astype(np.int64) << 8 | heads.octets[begin + 1], 0)
        bases[rows], kinds[rows], cut[rows] = at, kind, ~there
        heads.ran_out[rows] |= ~there & (at <= heads.whole[rows])
        rows = rows[np.isin(kind, ETHERTYPES_VLAN)]
    return np.ma.array(bases, mask=np.ma.getmaskarray(base)), np.ma.array(kinds, mask=cut)


def _network_layer(heads: _Heads, link: np.ndarray):
    """Offset of the network header, its version (4, 6 or 0) and the EtherType."""
    base = np.ma.masked_all(len(link), dtype=np.int64)
    type_at = np.ma.masked_all(len(link), dtype=np.int64)
    typed = ((LINK_ETHERNET, 14, 12), (LINK_COOKED, 16, 14), (LINK_COOKED2, 20, 0))
    for kind, header, at in typed:
        base[link == kind], type_at[link == kind] = header, at
    base[np.isin(link, (LINK_NULL, LINK_LOOP))] = 4
    base[np.isin(link, LINK_RAW)] = 0
    ether = heads.read(type_at, 2)
    # A length instead of a type: 802.2 with SNAP holds the type behind its own five bytes.
    snap = (link == LINK_ETHERNET) & _holds(ether < 0x0600) & _holds(heads.read(base, 4) == 0xAAAA0300)
    base, ether = _stepped(heads, snap, base, ether, 8)
    base, ether = _behind_tags(heads, base, ether)
    version = np.where(_holds(ether == ETHERTYPE_IPV4), 4, 0)
    version = np.where(_holds(ether == ETHERTYPE_IPV6), 6, version)
    untyped = np.ma.getmaskarray(type_at) & ~np.ma.getmaskarray(base)
    own = (heads.read(base, 1) >> 4).filled(0)
    version = np.where(untyped & np.isin(own, (4, 6)), own, version)
    return base, version, ether


def _skip_ipv6_extensions(heads: _Heads, kind: np.ma.MaskedArray, at: np.ma.MaskedArray):
    """Protocol, offset and whether it is a later fragment, behind the extension headers."""
    fragment = heads.none.copy()
    known = (*IPV6_OPTION_HEADERS, IPV6_FRAGMENT, IPV6_AUTH)
    while (pending := _holds(np.isin(kind.filled(-1), known))).any():
        here = _where(pending, at)
        units, offset = heads.read(here + 1, 1), heads.read(here + 2, 2) >> 3
        is_fragment = kind.filled(-1) == IPV6_FRAGMENT
        width = np.where(kind.filled(-1) == IPV6_AUTH, (units.filled(0) + 2) * 4, (units.filled(0) + 1) * 8)
        width = np.where(is_fragment, 8, width)
        fragment |= pending & is_fragment & _holds(offset > 0)
        following = heads.read(here, 1)
        cut = np.ma.getmaskarray(following) | np.ma.getmaskarray(units)
        kind = np.ma.array(
            np.where(pending, following.data, kind.data),
            mask=np.where(pending, cut, np.ma.getmaskarray(kind)),
        )
        at = np.ma.array(np.where(pending, at.data + width, at.data), mask=np.ma.getmaskarray(at))
    return kind, at, fragment


class _Network:
    """A network header of each row: where it begins, its version, and what it carries where."""

    def __init__(self, heads: _Heads, l3: np.ma.MaskedArray, version: np.ndarray):
        self.heads, self.l3, self.version = heads, l3, version
        self.v4, self.v6 = version == 4, version == 6
        self.at4, self.at6 = _where(self.v4, l3), _where(self.v6, l3)
        kind6, start6, fragment6 = _skip_ipv6_extensions(heads, heads.read(self.at6 + 6, 1), self.at6 + 40)
        self.word = heads.read(self.at4 + 6, 2)
        self.protocol = heads.read(self.at4 + 9, 1)
        self.l4 = _either(self.v6, start6, self.at4 + (heads.read(self.at4, 1) & 0x0F) * 4)
        self.kind = np.where(self.v6, kind6.filled(-1), self.protocol.filled(-1))
        later = (self.word & 0x1FFF != 0).astype(np.int64).filled(0)
        self.whole = (self.v4 | self.v6) & ~fragment6 & (later == 0)

    def end(self, sizes: np.ndarray) -> np.ndarray:
        """The packet ends where its own length says; 0 stands for segments joined by the network card."""
        stated = np.where(self.v6, self.heads.read(self.at6 + 4, 2).filled(0), self.heads.read(self.at4 + 2, 2).filled(0))
        begin = self.l3.filled(0) + np.where(self.v6, 40, 0)
        return np.where(stated > 0, np.minimum(begin + stated, sizes), sizes)

    def inner(self) -> tuple[np.ndarray, np.ma.MaskedArray, np.ndarray]:
        """Rows that carry another network header (IP in IP, 6in4, GRE), where it begins, and its version."""
        gre = self.whole & (self.kind == GRE)
        at = _where(gre, self.l4)
        bits, carried = self.heads.read(at, 2), self.heads.read(at + 2, 2)
        # Checksum (with an offset), key and sequence number are four bytes each, where their bits are set.
        width = 4 + sum(np.where(_holds(bits & bit != 0), 4, 0) for bit in (0x8000, 0x2000, 0x1000))
        version = np.where(gre & _holds(carried == ETHERTYPE_IPV4), 4, np.where(gre & _holds(carried == ETHERTYPE_IPV6), 6, 0))
        version = np.where(self.whole & (self.kind == IN_IPV4), 4, np.where(self.whole & (self.kind == IN_IPV6), 6, version))
        begin = np.ma.array(self.l4.data + np.where(gre, width, 0), mask=np.ma.getmaskarray(self.l4))
        there = (version > 0) & (self.heads.read(_where(version > 0, begin), 1) >> 4 == version)
        return _holds(there), begin, version


def _read_headers(heads: _Heads, sizes: np.ndarray, link: np.ndarray) -> dict[str, np.ma.MaskedArray]:
    l3, version, ether = _network_layer(heads, link)
    layer = _Network(heads, l3, version)
    end = layer.end(sizes)
    # IPv4 fields are those of the outermost IPv4 header, transport fields those of the innermost packet.
    at4, word, protocol = layer.at4, layer.word, layer.protocol
    step = layer.inner()
    while step[0].any():
        nested, begin, kind_of = step
        layer = _Network(heads, _either(nested, begin, layer.l3), np.where(nested, kind_of, layer.version))
        end = np.where(nested, np.minimum(end, layer.end(sizes)), end)
        found4 = np.ma.getmaskarray(at4) & ~np.ma.getmaskarray(layer.at4)
        at4, word, protocol = (_either(found4, new, old) for new, old in ((layer.at4, at4), (layer.word, word), (layer.protocol, protocol)))
        step = layer.inner()
    found = {
        "ip_proto_number": protocol,
        "ip_ttl": heads.read(at4 + 8, 1),
        "ip_id": heads.read(at4 + 4, 2),
        "ip_flags_df": (word & 0x4000 != 0).astype(np.int64).filled(0),
        "ip_flags_mf": (word & 0x2000 != 0).astype(np.int64).filled(0),
        "wrong_fragment": (word & 0x1FFF != 0).astype(np.int64).filled(0),
        "l3_offset": l3,
        "ip_version": np.where(version == 0, 0, version),
    }
    v4, v6, l4, kind, whole = layer.v4, layer.v6, layer.l4, layer.kind, layer.whole
    # IPv6 carries its own ICMP under another number, so ICMP means IPv4 here.
    tcp, udp, icmp = whole & (kind == TCP), whole & (kind == UDP), whole & v4 & (kind == ICMP)
    at_tcp, at_udp, at_icmp = _where(tcp, l4), _where(udp, l4), _where(icmp, l4)
    # Nine flag bits: the lowest bit beside the data offset belongs to them.
    flags = heads.read(at_tcp + 12, 2) & 0x1FF
    found |= {
        "tcp_sport": heads.read(at_tcp, 2),
        "tcp_dport": heads.read(at_tcp + 2, 2),
        "tcp_seq": heads.read(at_tcp + 4, 4),
        "tcp_ack": heads.read(at_tcp + 8, 4),
        "tcp_flag_int": flags.filled(0),
        "urgent_pointer": heads.read(at_tcp + 18, 2).filled(0),
        "tcp_window": heads.read(at_tcp + 14, 2),
        "tcp_dataofs": heads.read(at_tcp + 12, 1) >> 4,
        "udp_sport": heads.read(at_udp, 2),
        "udp_dport": heads.read(at_udp + 2, 2),
        "udp_len": heads.read(at_udp + 4, 2),
        "icmp_type": heads.read(at_icmp, 1),
        "icmp_code": heads.read(at_icmp + 1, 1),
    }
    for name, mask in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32)):
        found[f"tcp_flag_{name}"] = (found["tcp_flag_int"] & mask != 0).astype(np.int64)
    after = np.where(v4 | v6, end - l4.filled(0), sizes - l3.filled(0))
    after = np.where(tcp, after - found["tcp_dataofs"].filled(0) * 4, after)
    after = np.where(udp, np.minimum(found["udp_len"].filled(0), sizes - l4.filled(0)) - 8, after)
    after = np.where(icmp, after - 8, after)
    unknown = (
        np.ma.getmaskarray(l3)
        | ((v4 | v6) & np.ma.getmaskarray(l4))
        | (tcp & np.ma.getmaskarray(found["tcp_dataofs"]))
        | (udp & np.ma.getmaskarray(found["udp_len"]))
        | _holds(ether == ETHERTYPE_ARP)
    )
    found["payload_size"] = np.where(unknown, 0, np.maximum(after, 0))
    found["is_empty_payload"] = (found["payload_size"] == 0).astype(np.int64)
    found["ran_out"] = heads.ran_out.astype(np.int64)
    return found


@F.arrow_udf(HEADER_SCHEMA)
def _headers(heads: pa.Array, sizes: pa.Array, link: pa.Array) -> pa.Array:
    size = sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    kind = link.fill_null(-1).to_numpy(zero_copy_only=False)
    found = _read_headers(_Heads(heads, size), size, kind)
    columns = []
    for f in HEADER_SCHEMA:
        column = np.ma.asarray(found[f.name])
        arrow_type = pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32()
        columns.append(pa.array(column.data, arrow_type, mask=np.ma.getmaskarray(column)))
    return pa.StructArray.from_arrays(columns, names=HEADER_SCHEMA.names)


def header_fields(frame: str = "frame", linktype: str = "linktype") -> Column:
    """The header struct of a frame.

    Only the head of the frame travels to the function, unless reading it ran out of bytes that the
    frame has: those few frames (long extension chains, deep tags) travel again as a whole.
    """
    size, link = F.length(frame), F.col(linktype)
    head = _headers(F.substring(frame, 1, HEAD_OCTETS), size, link)
    cut = F.coalesce(head["ran_out"] == 1, F.lit(False))
    return F.when(cut, _headers(F.when(cut, F.col(frame)), size, link)).otherwise(head)


def decode_frames(frames: DataFrame, gap: Column | None = None, frame: str = "frame") -> DataFrame:
    """Replaces the binary ``frame`` column by the 30 packet feature columns.

    ``gap`` is the inter-arrival time in seconds; the literal 0.0 unless given.  All other
    input columns (capture id, packet number, exact time) are kept in front.
    """
    kept = [c for c in frames.columns if c not in (frame, "linktype")]
    own = {
        "timestamp": F.col("ts_us") / F.lit(1e6),
        "length": F.length(frame),
        "inter_arrival_time": F.lit(0.0) if gap is None else gap,
    }
    df = frames.select(
        *kept, *[own[name].alias(name) for name in _OF_FRAME], header_fields(frame).alias("_header")
    )
    features = [F.col(n) if n in own else F.col(f"_header.{n}") for n in FEATURE_SCHEMA.names]
    return df.select(*kept, *features)


def summarize_packets(
    frames: DataFrame, names: dict[int, str] | None = None, frame: str = "frame"
) -> DataFrame:
    """One line of facts per packet: source, destination, protocol name, length.

    IPv4 packets show their addresses and the protocol name (``IP#n`` when the number has
    none); other frames show the link addresses and the name of their outer layer.
    """
    kept = [c for c in frames.columns if c not in (frame, "linktype")]
    df = frames.withColumns({"_header": header_fields(frame), "_size": F.length(frame)})
    data, size, l3 = F.col(frame), F.col("_size"), F.col("_header.l3_offset")
    v4, v6 = F.col("_header.ip_version") == 4, F.col("_header.ip_version") == 6
    ethernet = F.col("linktype") == LINK_ETHERNET
    cooked = F.col("linktype").isin(LINK_COOKED, LINK_COOKED2)
    bare6 = v6 & ~ethernet
    places = {"src": (12, 8, 6), "dst": (16, 24, 0)}
    df = df.withColumns(
        {
            f"_{side}6": F.when(bare6, ipv6_groups(octets_at(data, size, l3 + at6, 16)))
            for side, (_, at6, _) in places.items()
        }
    )

    def address(side: str) -> Column:
        at4, _, link_at = places[side]
        ip4 = octets_at(data, size, l3 + at4, 4)
        link = octets_at(data, size, link_at, 6)
        text = (
            F.when(v4 & ip4.isNotNull(), ipv4_text(ip4))
            .when(~v4 & ethernet & link.isNotNull(), mac_text(link))
            .when(F.col(f"_{side}6") != "", ipv6_text(F.col(f"_{side}6")))
        )
        return F.coalesce(text, F.lit("unknown"))

    outer = (
        F.when(ethernet, "Ethernet")
        .when(cooked, "cooked linux")
        .when(F.col("linktype").isin(LINK_NULL, LINK_LOOP), "Loopback")
        .when(v6, "IPv6")
        .otherwise("Raw")
    )
    df = df.withColumn("proto", F.col("_header.ip_proto_number"))
    # At most 256 rows, so the broadcast does not grow with the data.
    df = df.join(F.broadcast(protocol_table(df.sparkSession, names)), "proto", "left")
    numbered = F.concat(F.lit("IP#"), F.col("proto").cast("string"))
    protocol = F.when(F.col("proto").isNotNull(), F.coalesce("proto_name", numbered)).otherwise(outer)
    return df.select(
        *kept,
        address("src").alias("src"),
        address("dst").alias("dst"),
        protocol.alias("protocol"),
        F.col("_size").alias("length"),
    )


def summary_line() -> Column:
    """The text form of a ``summarize_packets`` row."""
    return F.concat(
        F.lit("Packet: "), "src", F.lit(" → "), "dst",
        F.lit(" | Protocol: "), "protocol", F.lit(" | Length: "), F.col("length").cast("string"),
    )
