"""Delimited files with headers of their own, against Python's csv module."""

from __future__ import annotations

import csv
import gzip
import io
import random

import pytest

from cadastra.operators import gates as gt
from cadastra.sources import delimited as dl


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def by_name(text):
    return [{k: v for k, v in row.items() if k is not None} for row in csv.DictReader(io.StringIO(text, newline=""))]


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('\ufeffcode,name\r\n05,"a, ""b"""\r\n\r\n06\r\n07,x,y\r\n'.encode())
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write('name,note,code\n"two\nlines","in ""quotes""",08\nit"s,,"q"r\n')
    (tmp_path / "c.csv").write_text("code,code\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    df = dl.read_by_name(spark, str(tmp_path))
    assert df.columns == ["path", "_dataset", "_ordinal", "code", "name", "note"]
    assert {tuple(r)[1:] for r in df.collect()} == {
        ("a", 1, "05", 'a, "b"', None), ("a", 2, "06", None, None), ("a", 3, "07", "x", None),
        ("b", 1, "08", "two\nlines", 'in "quotes"'), ("b", 2, "qr", 'it"s', ""), ("c", 1, "2", None, None),
    }
    assert dl.read_by_name(spark, str(tmp_path), ["note"]).where("note IS NOT NULL").count() == 2
    rows = dl.read_cells(spark, str(tmp_path))
    assert {(r.path[-5:], r.problem) for r in gt.wrong_headers(dl.headers(spark, str(tmp_path)), ["code", "name"]).collect()} == {("sv.gz", "other names"), ("c.csv", "repeated name")}
    assert {(r._dataset, r._ordinal, r.problem) for r in gt.ragged_files(rows).collect()} == {("a", 2, "missing cells"), ("a", 3, "extra cells")}


@pytest.mark.parametrize("seed", range(3))
def test_random_files_in_many_splits(spark, tmp_path, tiny_splits, seed):
    random.seed(seed)
    expected = set()
    for n in range(2):
        out = io.StringIO(newline="")
        names = random.sample(["k", "v", "w w", 'q"'], 4)
        writer = csv.writer(out, lineterminator=random.choice(["\n", "\r\n"]))
        writer.writerow(names)
        for _ in range(40):
            writer.writerow("".join(random.choice('ab, "\n') for _ in range(random.choice([0, 1, 5, 60]))) for _ in names)
        text = out.getvalue()
        (tmp_path / f"f{n}.csv").write_bytes(text.encode())
        expected |= {(f"f{n}", i, *(row[c] for c in ["k", "v", "w w", 'q"'])) for i, row in enumerate(by_name(text), 1)}
    df = dl.read_by_name(spark, str(tmp_path), ["k", "v", "w w", 'q"'])
    assert {tuple(r) for r in df.drop("path").collect()} == expected
    assert dl.split_lines(spark, str(tmp_path)).select("path", "start").distinct().count() > 8


def test_an_unclosed_cell_fails_and_long_cells_do_not(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(Exception, match="not closed"):
        dl.read_by_name(spark, str(tmp_path / "bad.csv"), ["a"]).collect()
    long = '""' * 100_000 + "x" * 300_000
    (tmp_path / "long.csv").write_text(f'a,b\n1,"{long}"\n')
    [row] = dl.read_by_name(spark, str(tmp_path / "long.csv")).collect()
    assert row.b == long.replace('""', '"')


def test_lines_are_numbered_alike_for_any_splits(spark, tmp_path, tiny_splits):
    lines = [f"line {i}" for i in range(500)]
    (tmp_path / "x.txt").write_text("\n".join(lines) + "\n")
    got = sorted(tuple(r) for r in dl.text_rows(spark, str(tmp_path)).select("_ordinal", "line").collect())
    assert got == list(enumerate(lines))
