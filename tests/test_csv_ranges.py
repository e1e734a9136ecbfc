"""CSV in ranges: any place of the cuts gives the rows of the one-task reader."""

import csv
import io
import random

import pytest

from auditframe.errors import RefusedError
from auditframe.sources import csv_ranges, ranges
from auditframe.sources.csv_ranges import ends_inside
from auditframe.sources.scans import read_csv


def one_task(spark, path):
    return spark.read.csv(path, header=True, multiLine=True, escape='"', lineSep="\n", inferSchema=False)


def written(rows, eol="\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=eol).writerows(rows)
    return out.getvalue()


def random_rows(seed, n):
    draw = random.Random(seed)
    texts = ["", "plain", 'q"q', '""', "two\nlines", '"\n"', ",", '\n,"', "a,b\n\nc", 'end"', "é" * 30, '"start', 'x",\n"y', " lead", "z" * 300]
    return [("id", "a text", "b")] + [(i, draw.choice(texts) + draw.choice(texts), draw.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("range_bytes", [41, 250, 1 << 20])
def test_rows_of_the_one_task_reader(spark, tmp_path, as_rows, range_bytes):
    path = tmp_path / "x.csv"
    path.write_bytes(written(random_rows(range_bytes, 40)).encode())
    types = {"id": "bigint"}
    mine = read_csv(spark, str(path), types=types, range_bytes=range_bytes)
    theirs = one_task(spark, str(path)).selectExpr("cast(id as bigint) id", "nullif(`a text`, '') `a text`", "nullif(b, '') b")
    assert as_rows(mine) == as_rows(theirs)


def test_many_tasks_read_one_file(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(written(random_rows(1, 600)).encode())
    records = read_csv(spark, str(path), types={}, range_bytes=1500)
    assert records.count() == 600 and records.rdd.getNumPartitions() > 8


def test_line_ends_of_other_systems(spark, tmp_path, as_rows):
    path = tmp_path / "x.csv"
    path.write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,"z"')
    for size in (5, 1000):
        assert as_rows(read_csv(spark, str(path), range_bytes=size)) == [(1, "x\ny"), (2, "z")]
    path.write_bytes(b"a,b\r1,x\r2,y\r")
    with pytest.raises(RefusedError):
        read_csv(spark, str(path))
    assert as_rows(read_csv(spark, str(path), line_sep="\r")) == [(1, "x"), (2, "y")]


def test_a_quote_within_a_plain_field_opens_nothing():
    assert not ends_inside(b'5" pipe,7', False) and ends_inside(b'5" pipe,"7', False) and ends_inside(b'a,"b""', False)
    assert ends_inside(b"no quote", True) and not ends_inside(b'end",x', True) and ends_inside(b'end","', True)


def test_plain_quote_and_repeated_names_in_many_files(spark, tmp_path, as_rows):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.csv").write_bytes(f'a,a,\n{i},5" x,"p\nq"\n'.encode())
    df = read_csv(spark, str(folder), range_bytes=8)
    assert df.columns == ["a", "a.1", "Unnamed: 2"] and as_rows(df) == [(i, '5" x', "p\nq") for i in range(4)]
    (folder / "9.csv").write_bytes(b"a,,a\n1,2,3\n")
    with pytest.raises(Exception, match="another header"):
        read_csv(spark, str(folder), types={}).collect()


def test_the_first_pass_keeps_no_text(spark, tmp_path):
    """Lines without quotes could all be the end of a quoted text; one row of fixed size says so."""
    path = tmp_path / "x.csv"
    path.write_bytes(b"a,b\n" + b"".join(b"%d,plain\n" % i for i in range(3000)))
    lines = ranges.open_ranges(spark, str(path), "\n", 9000)
    found = lines.mapInArrow(csv_ranges._functions(False), csv_ranges.RANGE).collect()
    assert len(found) > 2 and {len(r) for r in found} == {4} and {tuple(r)[2:] for r in found} == {(False, True)}
    assert read_csv(spark, str(path), types={}, range_bytes=9000).count() == 3000
