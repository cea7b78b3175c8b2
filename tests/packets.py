"""Hand-built frames and capture files."""

from __future__ import annotations

import struct

MACS = bytes.fromhex("aabbccddeeff112233445566")


def ip4(proto: int, body: bytes, flags: int = 0x4000, ttl: int = 64, ident: int = 7238, options: bytes = b"", length: int | None = None) -> bytes:
    words = 5 + len(options) // 4
    total = words * 4 + len(body) if length is None else length
    head = struct.pack(">BBHHHBBH", 0x40 | words, 0, total, ident, flags, ttl, proto, 0)
    return head + bytes([172, 16, 10, 99, 192, 168, 0, 7]) + options + body


def ip6(following: int, body: bytes) -> bytes:
    head = struct.pack(">IHBB", 6 << 28, len(body), following, 64)
    return head + bytes.fromhex("20010db8000000000000000000000001fe80000000000000000000000000000f") + body


def tcp(sport=54321, dport=80, seq=4294967295, ack=2, flags=0x12, window=4095, urgent=7, payload=b"", words=5) -> bytes:
    head = struct.pack(">HHIIBBHHH", sport, dport, seq, ack, words << 4, flags, window, 0, urgent)
    return head + b"\0" * (words * 4 - 20) + payload


def udp(sport=5000, dport=53, payload=b"abcd") -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def ethernet(kind: int, body: bytes, tags: int = 0) -> bytes:
    return MACS + b"".join(struct.pack(">HH", 0x8100, 5) for _ in range(tags)) + struct.pack(">H", kind) + body


def pcap(packets: list[tuple[int, bytes]], order: str = "<", nanoseconds: bool = False, linktype: int = 1) -> bytes:
    magic, ticks = (0xA1B23C4D, 1000) if nanoseconds else (0xA1B2C3D4, 1)
    out = [struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, linktype)]
    for us, body in packets:
        out.append(struct.pack(order + "IIII", us // 1_000_000, us % 1_000_000 * ticks, len(body), len(body)) + body)
    return b"".join(out)


def _block(order: str, kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", 12 + len(body))
    return struct.pack(order + "I", kind) + size + body + size


def pcapng(packets: list[tuple[int, bytes]], order: str = "<", nanoseconds: bool = False) -> bytes:
    out = [_block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))]
    options = struct.pack(order + "HHB3xHH", 9, 1, 9, 0, 0) if nanoseconds else b""
    out.append(_block(order, 1, struct.pack(order + "HHI", 1, 0, 65535) + options))
    for us, body in packets:
        ticks = us * 1000 if nanoseconds else us
        head = struct.pack(order + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(body), len(body))
        out.append(_block(order, 6, head + body))
    out.append(_block(order, 5, b"\0" * 12))
    return b"".join(out)
