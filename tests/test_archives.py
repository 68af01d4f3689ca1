"""Archives against Python's own reader."""

import io
import random
import zipfile

import pytest

from medcorpus.sources import archives, readers


@pytest.fixture
def split_at(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def set_bytes(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "0")

    yield set_bytes
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


class Unseekable(io.BytesIO):
    """What makes Python's writer put sizes behind the data."""

    def seekable(self):
        return False

    def seek(self, *a):
        raise OSError

    def tell(self):
        raise OSError


def archive(members, streamed=False):
    out = Unseekable() if streamed else io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, method in members:
            z.writestr(zipfile.ZipInfo(name), data, method)
    return out.getvalue()


def members(rng, n):
    text = lambda: "".join(rng.choice("abé中 \nPK") for _ in range(rng.randrange(0, 900)))
    return [(f"{rng.choice(['p/', 'q/'])}ü{k}.{rng.choice(['txt', 'txt', 'md'])}", text().encode(), rng.choice([zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED])) for k in range(n)]


@pytest.mark.parametrize(("size", "streamed"), [(1500, False), (1500, True), (10**6, False)])
def test_same_as_python(spark, tmp_path, split_at, size, streamed):
    rng = random.Random(size + streamed)
    own = members(rng, 60)
    if streamed:
        own = [(n, d, zipfile.ZIP_DEFLATED) for n, d, _ in own]
    # signatures inside of data, of members that are stored as they are
    own.insert(20, ("p/inner.txt", archive([("p/deep.txt", b"deep", zipfile.ZIP_STORED)]) + b"PK\x03\x04 and more " * 3, zipfile.ZIP_DEFLATED))
    own.insert(0, ("p/bytes.txt", b"ab\xff\xfecd", zipfile.ZIP_DEFLATED))
    (tmp_path / "a b.zip").write_bytes(archive(own, streamed))
    (tmp_path / "empty.zip").write_bytes(archive([]))
    split_at(size)
    got = sorted(tuple(r) for r in readers.read_zip_members(spark, str(tmp_path), "p/", ".txt").collect())
    assert got == sorted((n, d.decode("utf-8", "ignore")) for n, d, _ in own if n.startswith("p/") and n.endswith(".txt"))
    listed = {(r.name, r["size"]) for r in archives.zip_index(spark, str(tmp_path)).collect()}
    assert listed == {(n, len(d)) for n, d, _ in own}


@pytest.mark.parametrize("size", [700, 10**6])
def test_signature_in_stored_data(spark, tmp_path, split_at, size):
    data = b"begin PK\x03\x04 middle PK\x03\x04" + b"x" * 2000 + b"PK\x03\x04 end"
    own = [("a.txt", b"one", zipfile.ZIP_STORED), ("b.txt", data, zipfile.ZIP_STORED), ("c.txt", b"three", zipfile.ZIP_DEFLATED)]
    (tmp_path / "z.zip").write_bytes(archive(own))
    split_at(size)
    assert sorted(tuple(r) for r in readers.read_zip_members(spark, str(tmp_path / "z.zip")).collect()) == [(n, d.decode()) for n, d, _ in own]


def test_bad_members_are_named(spark, tmp_path):
    own = [(f"{k}.txt", (f"text {k} " * 200).encode(), zipfile.ZIP_DEFLATED) for k in range(5)]
    whole = bytearray(archive(own))
    at = whole.find(b"2.txt") + 12
    whole[at : at + 8] = b"\xff" * 8
    (tmp_path / "bad.zip").write_bytes(bytes(whole))
    got = {r.name: (r.text, r.problem) for r in readers.read_zip_members(spark, str(tmp_path / "bad.zip"), strict=False).collect()}
    assert {n for n, (_, problem) in got.items() if problem} == {"2.txt"} and got["2.txt"][0] is None
    assert all(got[n] == (d.decode(), None) for n, d, _ in own if n != "2.txt")
    with pytest.raises(Exception, match="member 2.txt of .*bad.zip"):
        readers.read_zip_members(spark, str(tmp_path / "bad.zip")).collect()


def test_one_archive_is_many_tasks(spark, tmp_path, split_at):
    rng = random.Random(3)
    own = [(f"{k}.txt", rng.randbytes(3000).hex().encode(), zipfile.ZIP_DEFLATED) for k in range(400)]
    (tmp_path / "z.zip").write_bytes(archive(own))
    split_at(100_000)
    from medcorpus.sources import ranges

    assert ranges.pieces(spark, str(tmp_path / "z.zip"), "PK\x03\x04").rdd.getNumPartitions() > 8
    assert sorted(tuple(r) for r in readers.read_zip_members(spark, str(tmp_path / "z.zip")).collect()) == sorted((n, d.decode()) for n, d, _ in own)
