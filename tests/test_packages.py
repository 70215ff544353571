"""ZIP packages by ranges, as a table function in SQL and in DataFrames."""

import io
import random
import resource
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from saltmarsh.sources import packages


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("packages")
    with zipfile.ZipFile(folder / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/", "")
        z.writestr("d/one.txt", "one")
        z.writestr("../up", "x")
        z.writestr("two.txt", "zwei")
        z.writestr("big", b"\0" * 3_000_000)
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "d/one.txt")
        with pytest.warns(UserWarning):
            z.writestr("two.txt", "again")
    raw = (folder / "a.zip").read_bytes()
    (folder / "liar.zip").write_bytes(raw.replace(struct.pack("<I", 3_000_000), struct.pack("<I", 30)))
    with zipfile.ZipFile(folder / "stored.zip", "w") as z:
        z.writestr("x", "hello world")
    (folder / "torn.zip").write_bytes((folder / "stored.zip").read_bytes().replace(b"hello", b"hallo"))
    (folder / "none.zip").write_bytes(b"no zip")
    return folder


def test_members_by_lateral_join(spark, folder):
    names = ["a.zip", "stored.zip", "torn.zip", "none.zip", "absent.zip"]
    table = spark.createDataFrame([(n, f"file://{folder}/{n}") for n in names] + [("null", None)], "name string, path string").repartition(3)
    rows = packages.read_package_members(table, most_bytes=1_000_000).collect()
    got = {(r.name, r.member, None if r.content is None else bytes(r.content), r.problem) for r in rows}
    assert got == {
        ("a.zip", "d/one.txt", b"one", None), ("a.zip", "../up", None, "unsafe path"), ("a.zip", "two.txt", b"zwei", None), ("a.zip", "two.txt", None, "duplicate"), ("a.zip", "big", None, "too large"), ("a.zip", "link", None, "symlink"),
        ("stored.zip", "x", b"hello world", None), ("torn.zip", "x", None, "damaged"), ("none.zip", None, None, "not a ZIP file"), ("absent.zip", None, None, "not found"),
    }
    packages.register_package_members(spark, "members_here", 5_000_000)
    table.createOrReplaceTempView("packages_here")
    sql = spark.sql("SELECT p.name, count(*) AS n, sum(octet_length(m.content)) AS bytes FROM packages_here p, LATERAL members_here(p.path) m GROUP BY p.name")
    assert {r.name: (r.n, r.bytes) for r in sql.collect()} == {"a.zip": (6, 3_000_007), "stored.zip": (1, 11), "torn.zip": (1, None), "none.zip": (1, None), "absent.zip": (1, None)}


def test_sizes_are_those_of_what_is_read(folder):
    with open(folder / "liar.zip", "rb") as f:
        found = {r[0]: r for r in packages.members_of(f, 1_000_000)}
    assert found["big"][3] is None and found["big"][4] in ("too large", "damaged") and found["d/one.txt"][3] == b"one"


def test_memory_is_bounded(tmp_path):
    piece = random.Random(1).randbytes(1 << 20)
    with zipfile.ZipFile(tmp_path / "large.zip", "w") as z:
        for i in range(300):
            z.writestr(f"{i}", piece)

    class Counting(io.FileIO):
        most = 0

        def read(self, n=-1):
            Counting.most = max(Counting.most, n)
            return super().read(n)

        def readinto(self, buffer):
            Counting.most = max(Counting.most, len(buffer))
            return super().readinto(buffer)

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with Counting(tmp_path / "large.zip") as f:
        assert sum(len(r[3]) for r in packages.members_of(f)) == 300 << 20
    assert Counting.most <= 8 << 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10


def test_content_in_a_cell(spark, folder):
    both = spark.createDataFrame([("p", (folder / "stored.zip").read_bytes()), ("q", None)], "path string, content binary")
    assert {(r.package, r.member, r.problem) for r in packages.package_members(both).collect()} == {("p", "x", None), ("q", None, "not a ZIP file")}
    assert packages.package_members(both.where(F.lit(False))).count() == 0
