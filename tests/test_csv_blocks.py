"""CSV records over several lines, read in blocks."""

import random

import pytest

from ebbmark.sources import csv_blocks, readers


@pytest.fixture
def small_blocks(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(
    ("line", "inside", "expected"),
    [("a,b", False, False), ("a,b", True, True), ('"a', False, True), ('a",b', True, False), ('"a""', False, True), ('""', False, False), ('5" pipe,x', False, False),
     ('a""', True, True), ('a"x",y"', True, False), ('a","', True, True), ('"a","b,c"', False, False), (' "a', False, False), ('"""', False, True)],
)
def test_ends_inside(line, inside, expected):
    assert csv_blocks.ends_inside(line, inside) is expected


def _text(rng, n):
    cell = lambda: rng.choice(["plain", '"quoted, with ""two"" quotes"', '"over\nlines"', '"many\n\n' + "long line, of words\n" * rng.randrange(40) + 'end"', "", '""', '5" pipe', "é漢"])
    return "id,a,b\n" + "".join(f"{i},{cell()},{cell()}\n" + rng.choice(["", "", "\n"]) for i in range(n))


def test_blocks_equal_the_whole_file(spark, tmp_path, small_blocks):
    rng = random.Random(6)
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text(_text(rng, 60 + k))
    (tmp_path / "lone.csv").write_text('id,a,b\n1,"never closed\nto the end, of it\n' + "x\n" * 400 + "x")
    for path in (str(tmp_path / "part-0.csv"), str(tmp_path), str(tmp_path / "lone.csv")):
        whole = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
        got = csv_blocks.read_spanning(spark, path)
        assert got.columns == whole.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    path = tmp_path / "large.csv"
    path.write_text(_text(random.Random(7), 300))
    got = readers.read_csv(spark, str(path))
    assert got.rdd.getNumPartitions() > 20
    assert sorted(r.id for r in got.collect()) == list(range(300))


def test_headers(spark, tmp_path):
    for name, text in {"dup": 'a,A,,"b\nc"\n1,"x\ny",3,4\n', "crlf": 'a,b\r\n1,"x\r\ny"\r\n2,z\r\n'}.items():
        path = str(tmp_path / f"{name}.csv")
        with open(path, "w", newline="") as f:
            f.write(text)
        whole = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
        got = csv_blocks.read_spanning(spark, path)
        assert got.columns == whole.columns and got.collect() == whole.collect()
