from __future__ import annotations

import random
import struct

import pytest
from packets import ethernet, ip4, pcap, pcapng, tcp, udp

from packetloom.plans.extract import extract_features, land_captures, load_input
from packetloom.sources.captures import bounded_capture, capture_files, capture_index, capture_report, read_captures

FRAME = ethernet(0x0800, ip4(6, tcp()))


def packets(count: int, seed: int = 1) -> list[tuple[int, bytes]]:
    draw, now, out = random.Random(seed), 1_700_000_000_000_000, []
    for number in range(count):
        now += draw.randrange(5000)
        body = FRAME + draw.randbytes(draw.randrange(600))
        if number % 10 == 0:  # payload that looks like capture records
            body = FRAME + struct.pack("<IIII", 1_700_000_000, 5, 60, 60) * draw.randrange(1, 20)
        out.append((now, body))
    return out


def check(df, wanted):
    rows = df.orderBy("packet_no").collect()
    assert [(r.ts_us, bytes(r.frame)) for r in rows] == wanted
    assert [r.packet_no for r in rows] == list(range(len(wanted)))
    assert [r.previous_us for r in rows] == [None, *[us for us, _ in wanted]][: len(wanted)]


@pytest.mark.parametrize(
    "name, build, split",
    [
        ("a.pcap", lambda p: pcap(p), 1 << 26),
        ("a.pcap", lambda p: pcap(p), 9_000),
        ("a.pcap", lambda p: pcap(p, ">", True), 9_000),
        ("a.pcapng", lambda p: pcapng(p), 9_000),
        ("a.pcapng", lambda p: pcapng(p, ">", True), 1 << 26),
    ],
)
def test_formats_and_byte_ranges(spark, tmp_path, name, build, split):
    wanted = packets(150)
    (tmp_path / name).write_bytes(build(wanted))
    check(read_captures(spark, str(tmp_path / name), split, previous=True), wanted)


def test_range_that_begins_on_a_false_record(spark, tmp_path):
    """A payload that holds a whole plausible chain misleads a range; the check repairs it."""
    inner = pcap([(1_700_000_000_000_000 + i, b"q" * 40) for i in range(200)])[24:]
    wanted = [(1_700_000_000_000_000, FRAME), (1_700_000_000_000_500, FRAME + inner), (1_700_000_000_000_900, FRAME)]
    (tmp_path / "a.pcap").write_bytes(pcap(wanted))
    check(read_captures(spark, str(tmp_path / "a.pcap"), 2_000, previous=True), wanted)


def two_sections(count):
    """A file of two sections of opposite byte order, each with two interfaces that count time differently."""
    wanted, data = [], b""
    for section, order in enumerate("<>"):
        rows = [(us // 1000 * 1000, body) for us, body in packets(count, section)]
        fine, coarse = pcapng(rows, order), pcapng(rows, order, True)

        def blocks(raw):
            at = 0
            while at < len(raw):
                size = struct.unpack_from(order + "I", raw, at + 4)[0]
                yield struct.unpack_from(order + "I", raw, at)[0], raw[at : at + size]
                at += size

        first, second = list(blocks(fine)), list(blocks(coarse))
        announced = [b for k, b in first if k != 6] + [b for k, b in second if k == 1]
        bodies = [[b for k, b in held if k == 6] for held in (first, second)]
        data += b"".join(announced)
        for n in range(count):
            # Every other packet is of the second interface.
            block = bytearray(bodies[n % 2][n])
            struct.pack_into(order + "I", block, 8, n % 2)
            data += bytes(block)
        wanted += rows
    return data, wanted


@pytest.mark.parametrize("split", [700, 5_000, 60_000, 1 << 26])
def test_sections_and_interfaces_reach_every_range(spark, tmp_path, split):
    data, wanted = two_sections(120)
    (tmp_path / "a.pcapng").write_bytes(data)
    index = capture_index(capture_files(spark, str(tmp_path)), split)
    check(read_captures(spark, str(tmp_path / "a.pcapng"), split, previous=True, strict=True), wanted)
    assert index.where("packets > 0").count() > len(data) // max(split, 2_000) // 2


def test_range_that_begins_inside_a_packet_of_blocks(spark, tmp_path):
    inner = two_sections(60)[0]
    wanted = [(1_700_000_000_000_000, FRAME), (1_700_000_000_000_500, FRAME + b"xx" + inner), (1_700_000_000_000_900, FRAME)]
    for order in "<>":
        (tmp_path / "a.pcapng").write_bytes(pcapng(wanted, order))
        check(read_captures(spark, str(tmp_path / "a.pcapng"), 2_000, previous=True), wanted)


def test_cut_pcapng(spark, tmp_path):
    data, wanted = two_sections(50)
    (tmp_path / "a.pcapng").write_bytes(data[:-7])
    for split in (2_000, 1 << 26):
        index = capture_index(capture_files(spark, str(tmp_path)), split)
        assert [(r.packets, r.status) for r in capture_report(index).collect()] == [(99, "broken")]


def test_cut_empty_and_foreign_files(spark, tmp_path):
    wanted = packets(5)
    (tmp_path / "cut.pcap").write_bytes(pcap(wanted)[:-10])
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "text.pcap").write_bytes(b"this is not a capture at all")
    rows = read_captures(spark, str(tmp_path)).collect()
    report = {r.path.rsplit("/", 1)[1]: (r.packets, r.status) for r in capture_report(capture_index(capture_files(spark, str(tmp_path)))).collect()}
    assert report == {"cut.pcap": (4, "broken"), "text.pcap": (0, "foreign")}
    assert len(rows) == 4 and {r.capture_id.rsplit("/", 1)[1] for r in rows} == {"cut.pcap"}
    with pytest.raises(FileNotFoundError):
        read_captures(spark, str(tmp_path / "missing.pcap"))


def test_reader_gaps_equal_window_gaps(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(packets(60)))
    by_reader = load_input(spark, str(tmp_path / "a.pcap"))
    by_window = extract_features(read_captures(spark, str(tmp_path / "a.pcap"), 5_000))
    assert by_reader.count() == 60
    assert by_reader.exceptAll(by_window).count() == 0


def test_landing_and_bounds(spark, tmp_path):
    for name, first in (("a", 1), ("b", 101)):
        (tmp_path / "in").mkdir(exist_ok=True)
        packets = [((first + i) * 1_000_000, ethernet(0x0800, ip4(17, udp()))) for i in range(10)]
        (tmp_path / "in" / f"{name}.pcap").write_bytes(pcap(packets))
        for _ in range(2):  # a second run finds nothing new
            landed = land_captures(spark, str(tmp_path / "in"), str(tmp_path / "landed"), str(tmp_path / "state"))
            assert landed.count() == (10 if name == "a" else 20)
    first = landed.where("ts_us < 100000000")
    assert bounded_capture(first, packets=3).count() == 3
    assert bounded_capture(first, seconds=4).count() == 5
    assert bounded_capture(first, packets=2, seconds=4).agg({"packet_no": "max"}).first()[0] == 1
    assert bounded_capture(first, packets=0).count() == 10


def test_sparse_and_broken_captures(spark, tmp_path):
    sparse = [(i * 100_000_000_000, FRAME + bytes([i % 251]) * 40) for i in range(1, 401)]
    (tmp_path / "sparse.pcap").write_bytes(pcap(sparse))
    check(read_captures(spark, str(tmp_path / "sparse.pcap"), 4_000, previous=True), sparse)
    data = bytearray(pcap(packets(400)))
    at = 24
    for _ in range(200):
        at += 16 + struct.unpack_from("<I", data, at + 8)[0]
    struct.pack_into("<I", data, at + 8, 0xFFFFFF)
    (tmp_path / "broken.pcap").write_bytes(data)
    for split in (9_000, 1 << 26):
        index = capture_index(capture_files(spark, str(tmp_path / "broken.pcap")), split)
        assert [tuple(r)[1:] for r in capture_report(index).collect()] == [(200, "broken", len(data) - at)]
    with pytest.raises(ValueError, match="broken"):
        read_captures(spark, str(tmp_path), strict=True)


def test_unsupported_suffix(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        load_input(spark, str(tmp_path / "a.txt"))


def test_small_ranges_share_tasks_and_read_little(spark, tmp_path, monkeypatch):
    from packetloom.sources import captures

    wanted = packets(1500)
    (tmp_path / "a.pcap").write_bytes(pcap(wanted))
    frames = read_captures(spark, str(tmp_path / "a.pcap"), 2_000)
    ranges = -(-(tmp_path / "a.pcap").stat().st_size // 2_000)
    assert ranges > 200 and frames.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert frames.count() == 1500

    asked = []

    class Counted(captures.io.FileIO):
        def readinto(self, into):
            asked.append(len(into))
            return super().readinto(into)

    monkeypatch.setattr(captures, "open_binary", lambda path: Counted(path))
    size = (tmp_path / "a.pcap").stat().st_size
    row = type("Row", (), {"path": str(tmp_path / "a.pcap"), "start": 0, "stop": 2_000, "length": size})
    assert captures._index_range(row)["packets"] > 0 and max(asked) <= 1 << 13
