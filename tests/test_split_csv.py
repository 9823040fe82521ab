"""CSV read by splits against the reader that takes a file as one task."""

import csv
import random

import pytest

from bugsieve.sources import readers, split_csv

PIECES = ["plain", 'say "x"', "two\nlines", "a,b", "", '"', "é\n\n\nend", "x" * 90, '\n"\n', " padded "]


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    yield lambda n: [spark.conf.set(k, str(n)) for k in keys]
    for k, v in old.items():
        spark.conf.set(k, v)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("Description", "Fixing_time", "Label").collect())


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["Unnamed: 0", " Label", "Description", "Fixing_time"])
        out.writerows(rows)


def random_rows(seed, n):
    rng = random.Random(seed)
    return [
        (i, rng.choice([0, 1]), " ".join(rng.choice(PIECES) for _ in range(rng.randint(1, 4))) or "-", rng.choice([5, 12]))
        for i in range(n)
    ]


@pytest.mark.parametrize("size", [64, 300, 1 << 20])
def test_equal_to_the_reader_of_whole_files(spark, tmp_path, small_splits, size):
    for k in range(2):
        write(tmp_path / f"part-{k}.csv", random_rows(k, 120))
    want = as_rows(readers.read_csv_reports(spark, str(tmp_path), readers.FIX_SCHEMA))
    small_splits(size)
    got = split_csv.read_split_csv(spark, str(tmp_path), readers.FIX_SCHEMA)
    if size == 64:
        assert split_csv._lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 50
    assert as_rows(got) == want and len(want) == 240


def test_a_record_longer_than_many_splits(spark, tmp_path, small_splits):
    long = "line of text, with a comma\n" * 60 + 'and a "quote"'
    write(tmp_path / "one.csv", [(1, 1, "first", 3), (2, 0, long, 4), (3, 1, "last", 5)])
    small_splits(100)
    got = as_rows(split_csv.read_split_csv(spark, str(tmp_path), readers.FIX_SCHEMA))
    assert got == sorted([("first", 3, 1), ("last", 5, 1), (long, 4, 0)])


def test_windows_line_ends_blank_lines_and_no_records(spark, tmp_path, small_splits):
    write(tmp_path / "w.csv", [(1, 1, "a\r\nb", 3), (2, 0, "c", 4)], "\r\n")
    small_splits(16)
    assert as_rows(split_csv.read_split_csv(spark, str(tmp_path / "w.csv"), readers.FIX_SCHEMA)) == [("a\r\nb", 3, 1), ("c", 4, 0)]
    (tmp_path / "none.csv").write_text("Description,Label\n")
    assert split_csv.read_split_csv(spark, str(tmp_path / "none.csv"), readers.FIX_SCHEMA).count() == 0


def test_positions_put_rows_in_file_order(spark, tmp_path, small_splits):
    rows = [(i, 1, f"row {i}\n" * (1 + i % 3), 1) for i in range(40)]
    write(tmp_path / "p.csv", rows)
    small_splits(50)
    got = split_csv.read_split_csv(spark, str(tmp_path / "p.csv"), readers.FIX_SCHEMA, positions=True)
    assert [r["Description"] for r in got.orderBy(*readers.POSITION).collect()] == [r[2] for r in rows]


def test_exports_of_several_layouts_in_one_scan(spark, tmp_path, small_splits):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "one_bugs.csv").write_text("Summary,Description,Priority\ns1,d1,P1\ns2,,P2\n")
    (tmp_path / "a" / "deep" / "two_bugs.csv").write_text('Priority,Votes,Description, Extra\r\nP2,3,"d2\nmore",x\r\nP3\r\n')
    (tmp_path / "a" / "bad_bugs.csv").write_text("Summary,Body\nx,y\n")
    (tmp_path / "a" / "other.csv").write_text("Summary,Description,Priority\nno,no,no\n")
    (tmp_path / "a" / "empty_bugs.csv").write_text("")
    long = "many words, " * 40 + "\n" * 30
    (tmp_path / "a" / "long_bugs.csv").write_text(f'Description\n"{long}"\nshort\n')
    want = {tuple(r) for r in readers.read_tracker_exports(spark, str(tmp_path)).collect()}
    for size in (24, 1 << 20):
        small_splits(size)
        got = {tuple(r) for r in split_csv.read_split_exports(spark, str(tmp_path)).collect()}
        assert got == want and len(want) == 5
    nothing = tmp_path / "nothing"
    nothing.mkdir()
    (nothing / "x_bugs.csv").write_text("Summary\nx\n")
    assert split_csv.read_split_exports(spark, str(nothing)).count() == 0
    ordered = split_csv.read_split_exports(spark, str(tmp_path / "a" / "one_bugs.csv"), positions=True).orderBy(*readers.POSITION)
    assert [r["Summary"] for r in ordered.collect()] == ["s1", "s2"]
