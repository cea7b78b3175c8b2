from __future__ import annotations

import csv
import io

import pytest

from packetloom.sources import quoted
from packetloom.sources.sinks import write_table
from packetloom.sources.tabular import has_quoted_breaks, load_dataset, load_text

WORDS = ["plain", "two\nlines", "a,b", 'said "yes"', "\n\n", "é\r\nü", '"', '""\n"', "", "x" * 300]


def table_text(rows, ending="\n"):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator=ending)
    writer.writerow(["id", "no\nte", "other"])
    writer.writerows(rows)
    return out.getvalue()


def rows_of(count):
    return [[str(i), WORDS[i % len(WORDS)] + WORDS[i * 7 % 9], WORDS[i * 3 % len(WORDS)]] for i in range(count)]


def as_parsed(rows):
    return sorted(tuple(v or None for v in row) for row in rows)


@pytest.mark.parametrize("split_bytes", [1, 7, 64, 1000, 1 << 20])
def test_ranges_hold_every_record_once(tmp_path, split_bytes):
    path = tmp_path / "t.csv"
    rows = rows_of(60)
    path.write_bytes(table_text(rows).encode())
    size, data = path.stat().st_size, path.read_bytes()
    found = []
    for start in range(0, size, split_bytes):
        inside = data[:start].count(b'"') % 2
        records = quoted._range_records(str(path), start, min(start + split_bytes, size), inside)
        found += [r.decode() for r in records.to_pylist()]
    assert "".join(found) == data.decode().split('other\n', 1)[1]
    assert [next(csv.reader(io.StringIO(r, newline=""))) for r in found] == rows


@pytest.mark.parametrize("ending, last", [("\n", True), ("\r\n", True), ("\n", False)])
def test_many_ranges_equal_the_sequential_parse(spark, tmp_path, ending, last):
    text = table_text(rows_of(2000), ending)
    path = tmp_path / "t.csv"
    path.write_bytes((text if last else text[: -len(ending)]).encode())
    wanted = list(csv.reader(io.StringIO(text, newline="")))
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path STRING, length LONG")
    df = quoted.read_quoted(files, wanted[0], split_bytes=1500)
    assert df.columns == wanted[0] and df.rdd.getNumPartitions() > 20
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(as_parsed(wanted[1:]), key=str)


def test_folder_with_two_headers_and_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,note\n1,"one\ntwo"\n\n2\n')
    (tmp_path / "b.csv").write_text('note,label\nshort,1\n"ends ""so""\n",0')
    (tmp_path / "c.csv").write_text("x,note\n")
    assert has_quoted_breaks(spark, str(tmp_path))
    df = load_dataset(spark, str(tmp_path), source="file")
    assert {(r.x, r.note, r.label, r.file) for r in df.collect()} == {
        ("1", "one\ntwo", None, "a.csv"), ("2", None, None, "a.csv"), (None, "short", 1, "b.csv"), (None, 'ends "so"\n', 0, "b.csv"),
    }


def test_written_tables_come_back(spark, tmp_path):
    rows = [(i, WORDS[i % 9]) for i in range(40)]
    written = write_table(spark.createDataFrame(rows, "id INT, note STRING").repartition(3), str(tmp_path / "w.csv"))
    assert has_quoted_breaks(spark, written)
    found = [(int(r.id), r.note or "") for r in load_text(spark, written).collect()]
    assert sorted(found) == rows
    plain = write_table(spark.createDataFrame([(1, 'say "a"')], "id INT, note STRING"), str(tmp_path / "p.csv"))
    assert not has_quoted_breaks(spark, plain)
    assert [tuple(r) for r in load_text(spark, plain, source="f").select("id", "note").collect()] == [("1", 'say "a"')]
