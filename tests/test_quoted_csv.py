"""CSV with line breaks in quoted fields, cut at every place of the file."""

import csv
import random

import pytest

from phaselens.sources.quoted_csv import read_quoted_csv, read_records, turns_before
from phaselens.sources.quoted_csv import _lines
from phaselens.sources.schemas import FACT_RATINGS

OPTIONS = {"mode": "FAILFAST", "escape": '"'}


def _write(path, rows, sep="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=sep)
        out.writerow(FACT_RATINGS.fieldNames())
        out.writerows(rows)


def _rows(n, seed):
    rnd = random.Random(seed)
    bits = ["cold", 'he said "late"', "été", "a,b", "\n", "\n\n", '"', '""', "line one\nline two", '\n"x"\n,', " ", "名\n", "end"]
    return [(f"O{i}", f"C{i % 9}", None if i % 7 == 0 else f"R{i % 5}", rnd.choice([1.5, 4.0, None]),
             " ".join(rnd.choice(bits) for _ in range(rnd.randrange(6))).strip() or None, f"2025-06-{1 + i % 28:02d} 10:00", rnd.choice([0.25, None]))
            for i in range(n)]


def _whole(spark, path):
    return sorted(map(tuple, spark.read.schema(FACT_RATINGS).options(header=True, multiLine=True, **OPTIONS).csv(path).collect()), key=repr)


@pytest.fixture
def range_bytes(spark):
    """Sets the size of the ranges that files are cut into."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}

    def use(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "0")

    yield use
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("size", [7, 23, 64, 301, 10 ** 6])
def test_any_range_size_reads_what_one_task_reads(spark, tmp_path, range_bytes, size):
    path = str(tmp_path / "r.csv")
    rows = _rows(40, size)
    _write(path, rows)
    want = _whole(spark, path)
    range_bytes(size)
    got = read_quoted_csv(spark, path, FACT_RATINGS, OPTIONS)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == len(rows)
    if size < 1000:
        assert _lines(spark, path).rdd.getNumPartitions() > 4


def test_edges_inside_before_and_after_every_quote(spark, tmp_path, range_bytes):
    """A short file cut at each of its bytes."""
    path = str(tmp_path / "r.csv")
    rows = [("O1", "C1", "R1", 1.0, 'a\n"b"\n', "t", 0.5), ("O2", "C2", "R2", 2.0, "plain", "t", None), ("O3", None, "R3", None, "\n\n", "t", 1.0)]
    _write(path, rows)
    want = _whole(spark, path)
    for size in range(3, 60, 4):
        range_bytes(size)
        assert sorted(map(tuple, read_quoted_csv(spark, path, FACT_RATINGS, OPTIONS).collect()), key=repr) == want, size


def test_windows_line_ends_several_files_and_blank_lines(spark, tmp_path, range_bytes):
    _write(tmp_path / "a.csv", _rows(30, 1), "\r\n")
    _write(tmp_path / "b.csv", _rows(25, 2), "\r\n")
    with open(tmp_path / "b.csv", "a", newline="") as f:
        f.write("\r\n\r\n")
    (tmp_path / "c.csv").write_text(",".join(FACT_RATINGS.fieldNames()) + "\n")
    (tmp_path / "d.csv").write_text("")
    range_bytes(97)
    got = sorted(map(tuple, read_quoted_csv(spark, str(tmp_path), FACT_RATINGS, OPTIONS).collect()), key=repr)
    clean = [tuple(v for v in r) for r in _rows(30, 1) + _rows(25, 2)]
    assert got == sorted(clean, key=repr)


def test_a_field_over_many_ranges_is_one_record(spark, tmp_path, range_bytes):
    text = "\n".join(f"line {i}, \"{i}\"" for i in range(400))
    path = str(tmp_path / "r.csv")
    _write(path, [("O1", "C", "R", 1.0, text, "t", None), ("O2", "C", "R", 1.0, "x", "t", None)])
    range_bytes(200)
    got = {r["order_id"]: r["review_text"] for r in read_quoted_csv(spark, path, FACT_RATINGS, OPTIONS).collect()}
    assert got == {"O1": text, "O2": "x"}
    starts = turns_before(_lines(spark, path)).collect()
    assert len(starts) > 20 and {r["before"] % 2 for r in starts} == {0, 1}


def test_only_pieces_are_shuffled(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    _write(path, _rows(20, 5))
    plan = read_records(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    left, _, right = plan.partition("Union")
    assert "hashpartitioning(file" in right
