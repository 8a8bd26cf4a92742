"""Flat files cut anywhere, against the built-in reader that takes a file whole."""

from __future__ import annotations

import random
from contextlib import contextmanager

import pytest

from tabulon.sources import readers
from tabulon.sources.quoted_csv import ends_inside, read_quoted

WORDS = ["", "a", "b c", "x,y", "line\nbreak", "two\n\nbreaks", 'say ""hi""', '""', "\n", "crlf\r\ninside", "é", ",\n,", "long " * 40]


def _file(rng: random.Random, rows: int, end: str) -> str:
    def cell() -> str:
        kind = rng.random()
        if kind < 0.5:
            return '"' + "".join(rng.choices(WORDS, k=rng.randint(1, 4))) + '"'
        return rng.choice(["", "7", "plain", 'in"ch', 'stray "quote" here', "tail\""])

    lines = [f"{k},{cell()},{cell()}" for k in range(rows)]
    return end.join(["k,\"first\nname\",other", *lines]) + (end if rng.random() < 0.5 else "")


@contextmanager
def ranges_of(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("seed", range(3))
def test_rows_equal_the_whole_file_reader(spark, tmp_path, seed):
    rng = random.Random(seed)
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for part in range(2):
        (folder / f"{part}.csv").write_bytes(_file(rng, 80, "\r\n" if seed == 1 else "\n").encode())
    whole = readers._built_in(spark, str(folder), "UTF-8", True, {"lineSep": "\r\n"} if seed == 1 else {})
    for size in (97, 700):
        with ranges_of(spark, size):
            assert spark.read.text(str(folder / "0.csv"), lineSep="\n").rdd.getNumPartitions() > 5
            made = read_quoted(spark, str(folder), whole.columns)
        assert made.columns == ["k", "first\nname", "other"] and _rows(made) == _rows(whole) and made.count() == 160
    read = readers.read_csv(spark, str(folder))
    assert read.columns == made.columns and dict(read.dtypes)["k"] == "bigint" and read.count() == 160


def test_one_row_over_many_ranges(spark, tmp_path):
    path = tmp_path / "t.csv"
    text = "\n".join(f"line {k} of ,a text, " + "w" * (k % 130) for k in range(100))
    path.write_bytes(f'\ufeffa,"b"\n1,"{text}"\n2,"x"\n3,"{text}"'.encode())
    with ranges_of(spark, 500):
        made = read_quoted(spark, str(path), ["a", "b"])
    assert sorted(tuple(r) for r in made.collect()) == [("1", text), ("2", "x"), ("3", text)]
    assert readers.read_csv(spark, str(path)).columns == ["a", "b"]


def test_edges(spark, tmp_path):
    def read(content: bytes, **options):
        path = tmp_path / f"{abs(hash(content))}.csv"
        path.write_bytes(content)
        df = readers.read_csv(spark, str(path), **options)
        return df.columns, [tuple(r) for r in df.collect()]

    assert read(b"a,b\n") == (["a", "b"], [])
    assert read(b'\n\na,b\n\n1,"x\n"\n\n') == (["a", "b"], [(1, "x\n")])
    assert read(b"a;b\n1;\"u;\nv\"\n", sep=";") == (["a", "b"], [(1, "u;\nv")])
    assert read(b"a,b\n1\n2,x,surplus\n") == (["a", "b"], [(1, None), (2, "x")])
    assert read(b"a,b\r1,x\r2,y\r") == (["a", "b"], [(1, "x"), (2, "y")])
    assert read('é,b\n"ü\n",2\n'.encode("latin-1")) == (["é", "b"], [("ü\n", 2)])
    assert read("é,b\n\"ü\n\",2\n".encode()) == (["é", "b"], [("ü\n", 2)])
    assert len(read(b'a,b\n1,"never closed\n2,x\n')[1]) == 1


def test_state_of_a_line():
    assert ends_inside(b'1,"open', False) and not ends_inside(b'1,"open', True)
    assert not ends_inside(b'5" pipe,6" pipe', False) and ends_inside(b'x"",y', True)
    assert ends_inside(b'close","again', True) and not ends_inside(b'a""', False) and not ends_inside(b'"a""b"', False)
    assert ends_inside(b'"""', False) and not ends_inside(b'""', False) and ends_inside(b'""', True)
