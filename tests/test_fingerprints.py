"""File fingerprints by ranges and content fingerprints by sums."""

import hashlib
import random

import pytest

from auditframe.functions.identity import content_fingerprint, content_sums, fingerprint_of, merged_sums
from auditframe.sources.scans import file_branches, file_fingerprints


@pytest.mark.parametrize("content", [b"\n", b"one", b"one\n", b"a\n\nb", b"\x00\xff\r\n\xfe" * 50])
def test_a_small_file_has_the_digest_of_its_bytes(spark, tmp_path, content):
    (tmp_path / "f").write_bytes(content)
    row = file_fingerprints(spark, str(tmp_path / "f")).first()
    assert (row["byte_size"], row["sha256"]) == (len(content), hashlib.sha256(content).hexdigest())


def test_a_file_that_grows_keeps_its_branches(spark, tmp_path):
    draw = random.Random(1)
    content = bytes(draw.choice(b"abc\n") for _ in range(5000))

    def leaves():
        return {r["start"]: r["sha256"] for r in file_branches(spark, str(tmp_path / "f"), 1000).collect()}

    (tmp_path / "f").write_bytes(content)
    before = leaves()
    (tmp_path / "f").write_bytes(content + b"more\n" * 10)
    after = leaves()
    assert len(before) == 5 and [s for s in before if after[s] != before[s]] in ([], [4000])
    (tmp_path / "f").write_bytes(content[:2500] + b"X" + content[2501:])
    assert [s for s, d in leaves().items() if d != before[s]] in ([2000], [1000])


def test_sums_of_parts_are_sums_of_the_whole(spark):
    rows = [(i, None if i % 3 else f"t{i}", i / 7, i % 2 == 0) for i in range(50)]
    kinds = "a long, b string, c double, d boolean"
    df = spark.createDataFrame(rows, kinds)
    parts = [content_sums(spark.createDataFrame(rows[a:b], kinds)) for a, b in ((0, 20), (20, 20), (20, 50))]
    merged = merged_sums(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert fingerprint_of(merged).first() == content_fingerprint(df.repartition(7)).first()
    assert content_fingerprint(spark.createDataFrame(rows[:-1] + [rows[0]], kinds)).first() != content_fingerprint(df).first()
    assert content_fingerprint(spark.createDataFrame([("1:a", "b")], "x string, y string")).first() != content_fingerprint(spark.createDataFrame([("1", "a1:b")], "x string, y string")).first()
