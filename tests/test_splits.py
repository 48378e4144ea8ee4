"""Quoted line breaks in files that many tasks read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from grantmill.sources import readers, splits
from tests.conftest import rows


def made_lines(n, seed=0):
    """Records with quoted breaks, separators and quotes, bare quotes, short, long and blank lines."""
    rng = random.Random(seed)
    quoted = ['"a\tb"', '"line\nbreak"', '"say ""so"""', '"\n\n"', '""', '"x"', '"q""\n""q"', '"long\n' + "w\n" * 9 + '"']
    plain = ["x", "", 'five" disk', "é中", "y z", "o'k", '7"', " lead"]
    out = []
    for i in range(n):
        fields = [str(i), *[rng.choice(quoted if rng.random() < 0.5 else plain) for _ in range(rng.choice((3, 3, 3, 2, 4)))]]
        out.append("\t".join(fields))
        if rng.random() < 0.02:
            out.append("")
    return out


def write(path, lines, end="\n"):
    path.write_bytes(("a\tb\tc\td" + end + end.join(lines) + end).encode())
    return str(path)


def whole(spark, path):
    reader = readers._csv_reader(spark, "\t", True)
    return reader.csv(path)


@pytest.mark.parametrize("size", [37, 64, 200, 1000, 1 << 20])
def test_same_rows_whatever_the_ranges(spark, settings, tmp_path, size):
    path = write(tmp_path / "raw.tsv", made_lines(300, seed=size))
    expected = rows(whole(spark, path))
    settings(files__maxPartitionBytes=str(size), files__openCostInBytes="0")
    found = readers.scan_raw_table(spark, path, ["a", "b", "c", "d"])
    assert rows(found) == expected


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_marked_lines_whatever_the_ranges(spark, settings, tmp_path, size):
    path = write(tmp_path / "raw.tsv", made_lines(150, seed=7))
    settings(files__maxPartitionBytes=str(size), files__openCostInBytes="0")
    found = readers.tolerant_parse(spark, path).select("a", F.col(readers.CORRUPT).isNotNull().alias("is_bad"))
    fields = {line.split("\t")[0]: None for line in made_lines(150, seed=7) if line}
    assert sorted(found.toPandas()["a"], key=int) == sorted(fields, key=int)
    assert found.where("is_bad").count() > 20


def test_one_file_is_read_by_many_tasks(spark, settings, tmp_path):
    path = write(tmp_path / "raw.tsv", made_lines(20000))
    settings(files__maxPartitionBytes="65536", files__openCostInBytes="0")
    found = readers.scan_raw_table(spark, path, ["a", "b"])
    tasks = found.select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks > 8
    assert found.count() == whole(spark, path).count()


def test_ordinals_follow_the_file(spark, settings, tmp_path):
    path = write(tmp_path / "raw.tsv", made_lines(500, seed=2))
    settings(files__maxPartitionBytes="90", files__openCostInBytes="0")
    found = readers.scan_raw_table(spark, path, ["a"], ordinal="place").orderBy("place")
    assert [r.a for r in found.collect()] == [str(i) for i in range(500)]


def test_several_files_and_line_ends(spark, settings, tmp_path):
    folder = tmp_path / "raw.tsv"
    folder.mkdir()
    write(folder / "part-0.tsv", made_lines(80, seed=3))
    write(folder / "part-1.tsv", made_lines(80, seed=4))
    expected = rows(whole(spark, str(folder)))
    settings(files__maxPartitionBytes="120", files__openCostInBytes="0")
    assert rows(readers.scan_raw_table(spark, str(folder), ["a", "b", "c", "d"])) == expected
    plain = [line for line in made_lines(50, seed=5) if "\n" not in line]
    returned = write(tmp_path / "returned.tsv", plain, "\r\n")
    assert rows(readers.scan_raw_table(spark, returned, ["a", "b", "c", "d"])) == rows(whole(spark, returned))


def test_an_open_quote_runs_to_the_end_of_the_file(spark, settings, tmp_path):
    path = write(tmp_path / "raw.tsv", ["1\tx\ty\tz", '2\tx\ty\t"never closed', "3\tx\ty\tz", "4"])
    settings(files__maxPartitionBytes="20", files__openCostInBytes="0")
    found = readers.scan_raw_table(spark, path, ["a", "d"])
    assert [r.a for r in found.orderBy("a").collect()] == ["1", "2"]
    assert found.where("a = 2").first().d.strip() == "never closed\n3\tx\ty\tz\n4"


def test_very_long_records_are_read_whole(spark, settings, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "LONGEST_PART", 50)
    path = write(tmp_path / "raw.tsv", ['1\t"' + "w\n" * 100 + '"\ty\tz', "2\tx\ty\tz"])
    settings(files__maxPartitionBytes="60", files__openCostInBytes="0")
    assert rows(readers.scan_raw_table(spark, path, ["a", "b"])) == rows(whole(spark, path).select("a", "b"))
    placed = readers.scan_raw_table(spark, path, ["a"], ordinal="place").orderBy("place")
    assert [r.a for r in placed.collect()] == ["1", "2"]


def test_headers_must_agree(spark, tmp_path):
    folder = tmp_path / "raw.tsv"
    folder.mkdir()
    write(folder / "part-0.tsv", ["1\tx\ty\tz"])
    (folder / "part-1.tsv").write_text("a\tc\tb\td\n1\tx\ty\tz\n")
    with pytest.raises(Exception, match="header"):
        readers.scan_raw_table(spark, str(folder), ["a"]).collect()


@pytest.mark.parametrize(
    "line, outside, inside",
    [
        ("x\ty", False, True),
        ('"x', True, False),
        ('x"\ty', False, False),
        ('x\t"y', True, False),
        ('"x""y"', False, False),
        ('""', False, True),
        ('"x"y\t"z', True, True),
        ('a"b"c', False, False),
        ("", False, True),
    ],
)
def test_ends_inside(line, outside, inside):
    assert splits.ends_inside(line, False) == outside
    assert splits.ends_inside(line, True) == inside


def test_texts_stay_out_of_the_windows_of_a_file(spark, settings, tmp_path):
    """One task sees all ranges of a file: it gets where they end, and not the texts that reach out of them."""
    path = write(tmp_path / "raw.tsv", made_lines(2000, seed=5))
    settings(files__maxPartitionBytes="5000", files__openCostInBytes="0")
    found = splits.summaries(spark, path, "\t").localCheckpoint()
    states = splits.with_states(found)
    assert states.columns == ["file", "block", "opens"]
    assert states.count() == found.count() == splits.with_texts(found).where("read IS NOT NULL").count() > 4
