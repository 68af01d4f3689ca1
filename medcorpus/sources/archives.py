"""Members of zip archives, read range by range.

Each member begins with a signature, so Spark's text reader cuts an archive at it, in parallel and through any file system: a piece is a
member's header and data, the last one also the archive's directory. A piece tells by itself whether it is whole, by the size in its
header or by the end of the compressed stream. One that is not, because the signature stands inside its data by chance, goes on with the next
piece; if that is in the next range, both are passed on and joined. A member must fit one task, an archive need not.

What counts is the directory, as for any reader: members that it does not list (deleted ones) are left out, and listed ones whose data are not
there, or not intact, are named as such. The directory of an archive is read by the task of its last member.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.sources import ranges
from medcorpus.storage import stored

#: What members and the directory's entries begin with, and the fields after that.
MEMBER, ENTRY = b"PK\x03\x04", b"PK\x01\x02"
HEADER, LISTED = struct.Struct("<HHHHHIIIHH"), struct.Struct("<HHHHHHIIIHHHHHII")
STORED, DEFLATED = 0, 8
_ROW = "file long, block long, at int, kind string, name string, crc long, size long, place long, text string, raw binary"


@dataclass
class Member:
    """A whole member: its name and data, or what is wrong with it; rest is what stands behind its data."""

    name: bytes
    data: bytes | None
    crc: int
    rest: bytes
    problem: str | None = None


def is_header(piece: bytes) -> bool:
    """Whether a piece looks like the beginning of a member."""
    if len(piece) < HEADER.size:
        return False
    version, _, method, *_, n_name, n_extra = HEADER.unpack_from(piece)
    return version & 255 <= 63 and method <= 99 and 0 < n_name and HEADER.size + n_name + n_extra <= len(piece)


def read_member(piece: bytes) -> Member | None:
    """The member that a piece (without its signature) holds; None if it goes on."""
    _, flags, method, _, _, crc, packed, _, n_name, n_extra = HEADER.unpack_from(piece)
    begin = HEADER.size + n_name + n_extra
    name, known = piece[HEADER.size : HEADER.size + n_name], not flags & 8
    if known and packed == 0xFFFFFFFF:  # the size of a large member is in the extra field
        extra, at = piece[HEADER.size + n_name : begin], 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1 and size >= 16:
                packed = struct.unpack_from("<Q", extra, at + 12)[0]
            at += 4 + size
    if known and len(piece) - begin < packed:
        return None
    if flags & 1 or method not in (STORED, DEFLATED) or (method == STORED and not known):
        return Member(name, None, crc, piece[begin + packed :] if known else b"", "encrypted, or packed in an unknown way")
    if method == STORED:
        data, rest = piece[begin : begin + packed], piece[begin + packed :]
    else:
        stream = zlib.decompressobj(-15)
        try:
            data = stream.decompress(piece[begin : begin + packed] if known else piece[begin:])
        except zlib.error as e:
            return Member(name, None, crc, b"", str(e))
        if not stream.eof:
            return Member(name, None, crc, piece[begin + packed :], "cut off") if known else None
        rest = piece[begin + packed :] if known else stream.unused_data
    if not known:
        crc = struct.unpack_from("<I", rest, 4 if rest.startswith(b"PK\x07\x08") else 0)[0] if len(rest) >= 8 else 0
    return Member(name, data if zlib.crc32(data) == crc else None, crc, rest, None if zlib.crc32(data) == crc else "wrong checksum")


def listed(rest: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """(name, checksum, size, place) of the directory that stands in what is behind a member."""
    at = rest.find(ENTRY)
    while at >= 0 and rest.startswith(ENTRY, at) and at + 4 + LISTED.size <= len(rest):
        own = LISTED.unpack_from(rest, at + 4)
        crc, size, n_name, n_extra, n_comment, place = own[6], own[8], own[9], own[10], own[11], own[15]
        begin = at + 4 + LISTED.size
        yield rest[begin : begin + n_name], crc, size, place
        at = begin + n_name + n_extra + n_comment


def _scan(batches, prefix: bytes, suffix: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of _ROW: members and entries that are wanted, and pieces that go over the end of a range."""
    out, key, held, at = [], None, [], 0

    def wanted(name: bytes) -> bool:
        return name.startswith(prefix) and name.endswith(suffix) and not name.endswith(b"/")

    def put(kind: str, name=None, crc=None, size=None, place=None, text=None, raw=None) -> None:
        out.append((*key, at, kind, None if name is None else name.decode("utf-8", "replace"), crc, size, place, text, raw))

    def member(m: Member) -> None:
        if wanted(m.name):
            put("member" if m.problem is None else "bad", m.name, m.crc, text=m.problem if m.data is None else m.data.decode("utf-8", "ignore"))
        for name, crc, size, place in listed(m.rest):
            if wanted(name):
                put("entry", name, crc, size, place)

    def pieces_so_far(last: bool) -> None:
        """Takes members from the pieces held; what is still open stays, or goes on to the next range."""
        nonlocal held, at
        while held:
            if not is_header(held[0]):  # behind the signature of an earlier range's member
                put("part", raw=held.pop(0))
                at += 1
                continue
            for n in range(1, len(held) + 1):
                found = read_member(MEMBER.join(held[:n]))
                if found and not (found.problem and n > 1):
                    member(found)
                    held = held[n:]
                    break
                if found:  # the pieces after the first did not help: it alone is bad
                    member(Member(found.name, None, found.crc, b"", found.problem))
                    held = held[1:]
                    break
            else:
                if not last:
                    return
                put("begun", raw=MEMBER.join(held))
                at += 1
                held = []

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _ROW.split(", ")])

    for b in batches:
        for file, block, value in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if (file, block) != key:
                if held:
                    pieces_so_far(True)
                key, at, first = (file, block), 0, block == 0
            else:
                first = False
            if first:  # what stands before the first member of a file; an empty archive's directory
                continue
            held.append(value)
            pieces_so_far(False)
            if len(out) >= 100:
                yield batch()
                out.clear()
    if held:
        pieces_so_far(True)
    if out:
        yield batch()


def _joined(key: tuple, parts, prefix: bytes, suffix: bytes):
    """The members that the parts of a file make, which come in order."""
    import pandas as pd

    parts = parts.sort_values(["block", "at"])
    pieces, groups = [bytes(x) for x in parts["raw"]], []
    for kind, raw in zip(parts["kind"], pieces, strict=True):
        if kind == "begun" or not groups:
            groups.append([raw])
        else:
            groups[-1].append(raw)
    rows = []
    for g in groups:
        whole = pa.RecordBatch.from_arrays([pa.array([key[0]] * 2), pa.array([0] * 2, pa.int64()), pa.array([b"", MEMBER.join(g)], pa.binary())], names=["file", "block", "value"])
        for b in _scan([whole], prefix, suffix):
            rows += [r for r in b.to_pylist() if r["kind"] in ("member", "bad", "entry")]
        if not is_header(g[0]):
            continue
        if read_member(MEMBER.join(g)) is None:
            n = HEADER.unpack_from(g[0])[8]
            name = g[0][HEADER.size : HEADER.size + n]
            if name.startswith(prefix) and name.endswith(suffix):
                rows.append({"file": key[0], "block": 0, "at": 0, "kind": "bad", "name": name.decode("utf-8", "replace"), "crc": None, "size": None, "place": None, "text": "cut off", "raw": None})
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _ROW.split(", ")])


def _found(spark: SparkSession, path: str | list[str], prefix: str, suffix: str) -> DataFrame:
    own = prefix.encode(), suffix.encode()
    cut = ranges.pieces(spark, path, MEMBER.decode()).select("file", "block", F.col("value").cast("binary").alias("value"))
    rows = stored(cut.mapInArrow(lambda it: _scan(it, *own), _ROW))
    # signatures inside of data, at the border of two ranges: a handful
    parts = rows.filter("kind in ('part', 'begun')").groupBy("file").applyInPandas(lambda k, p: _joined(k, p, *own), _ROW)
    whole = rows.filter("kind in ('member', 'bad', 'entry')").unionByName(parts)
    files = ranges.files(spark, path)
    return stored(whole.drop("raw")).join(files, "file")


def zip_index(spark: SparkSession, path: str | list[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """archive, name, crc, size, place (first byte) of the members that archives list."""
    return _found(spark, path, prefix, suffix).filter("kind = 'entry'").select("archive", "name", "crc", "size", "place")


def zip_members(spark: SparkSession, path: str | list[str], prefix: str = "", suffix: str = ".txt") -> DataFrame:
    """archive, name, text, problem of the members that archives list: their texts, without bytes that are not UTF-8, or what is wrong with them."""
    found = _found(spark, path, prefix, suffix)
    entries = found.filter("kind = 'entry'").select("archive", "name", "crc")
    good = found.filter("kind = 'member'").select("archive", "name", "crc", "text").dropDuplicates(["archive", "name", "crc"])
    bad = found.filter("kind = 'bad'").groupBy("archive", "name").agg(F.min("text").alias("why"))
    # of a name that is listed twice the last entry counts; both have their data here
    met = entries.dropDuplicates().join(good.withColumn("there", F.lit(True)), ["archive", "name", "crc"], "left").join(bad, ["archive", "name"], "left")
    problem = F.when(F.col("there").isNull(), F.coalesce("why", F.lit("no data")))
    return met.select("archive", "name", "text", problem.alias("problem"))
