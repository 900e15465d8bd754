"""Heads of files of any size: a file that no value can hold has one too."""

from idsieve.queries import jobs as qj
from idsieve.sources import files as sfiles


def test_a_file_beyond_two_gigabytes_has_a_row(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"PAR1 and more")
    with open(tmp_path / "b.parquet", "wb") as f:  # sparse: it takes no room
        f.write(b"HEAD")
        f.truncate(2**31 + 5)
    got = {(r.filename, r.size_bytes, r.head) for r in qj.q_files(spark, str(tmp_path)).collect()}
    assert got == {("a.parquet", 13, "50415231"), ("b.parquet", 2**31 + 5, "48454144")}


def test_both_ways_agree(spark, tmp_path):
    for name, data in (("x y.png", b"12345678"), ("z%20.png", b"abc"), ("no.txt", b"---")):
        (tmp_path / name).write_bytes(data)
    rows = lambda d: sorted((r.path, r.modified, r.size_bytes, r.filename, bytes(r.head)) for r in d.collect())
    one, other = (rows(sfiles.read_heads(spark, str(tmp_path), "*.png", 4, whole)) for whole in (100, 2))
    assert one == other and [x[4] for x in one] == [b"1234", b"abc"]
    assert [x[:4] for x in one] == sorted(tuple(r)[:4] for r in sfiles.read_files(spark, str(tmp_path), "*.png").collect())
