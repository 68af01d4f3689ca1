"""The prefix trie of conversations, shard by shard.

A turn is a record of ``RECORD`` bytes, the SHA-256 of its role and text and the text's length, and a conversation its records one after
another, so conversations are ordered like binary strings and a node is a prefix. Equal conversations become one row with
their number before anything is sorted; distinct ones are dealt in ranges, so a shard holds neighbours, and a hot
beginning is spread over as many shards as it fills.

A shard numbers its distinct turns and builds a ternary search tree over the numbers: conversations are inserted from the middle outward (the
median first, then the medians of both halves), which balances the tree of each turn's followers. One pass over the depths,
from the deepest up, gives each node's members, smallest member, children, leaves and savings. Only nodes on the way to
a shard's first or last conversation can be in another shard too. They are the shard's edge, are merged by Spark over all
shards, and add up along the edges, so that what crosses tasks is a few paths a shard.

The list of the conversations that end at a node can be a third of all. Ids are sorted in ranges of (conversation, id); a run within one
range is hashed there, one that meets a range's border is passed on as text of at most ``CHUNK`` bytes a row and streamed, in
order, through one hash (SHA-256 is sequential); no task holds such a list.

A conversation is a bounded object here (one training sample), sorted in one task; shards follow the number of turns.

Cases: a null role or text is empty; equal turn numbers are ordered by role, then text, repeated rows are turns of their own; rows with a
null conv_id belong to no conversation and make no node; of a negative id c, c % 5 is as in SQL (towards zero); very long texts are only
hashed; other columns are not read; an empty table has no root, so no rows.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from medcorpus.llm.common import kept_by, scratch, stored, table

DIGEST, RECORD = 32, 40
#: About so many turns of distinct conversations are in a shard.
SHARD_TURNS = 200_000
#: Ids of a node's conversations are passed on in pieces of this many characters.
CHUNK = 1 << 20
#: In the contract's rebuilt conversations, a family of this many shares its first member's first turns, less than MOST_SHARED.
FAMILY, MOST_SHARED = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


def recorded(turns: DataFrame) -> DataFrame:
    """conv_id and seq, all records in order, of turns(conv_id, turn, role, text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).filter("conv_id is not null")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).alias("place")
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    record = F.concat(said, F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0"))
    placed = rows.select("conv_id", place, record.alias("record"))
    own = F.sort_array(F.collect_list(F.struct("place", "record")))
    return placed.groupBy("conv_id").agg(own.alias("own")).select("conv_id", F.unhex(F.array_join(F.col("own.record"), "")).alias("seq"))


def first_turns(seq: Column, n: Column | int) -> Column:
    return F.substring(seq, F.lit(1), F.lit(n) * RECORD)


def rebuilt(own: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns of the family's first, then what comes after the first h of one's own."""
    heads = own.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), first_turns(F.col("seq"), MOST_SHARED).alias("head"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    rows = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family", "left")
    h = shared.cast("int")
    rest = F.substring("seq", h * RECORD + 1, F.octet_length("seq"))
    return rows.select("conv_id", F.concat(F.coalesce(first_turns(F.col("head"), h), F.lit(b"")), rest).alias("seq"))


# the conversations that end at a node


def _runs(batches) -> Iterator[pa.RecordBatch]:
    """Of ids sorted by key: a digest for each run inside the partition; of the others the ids as text."""
    rows, key, ids, size, start, whole = [], None, [], 0, None, False

    def piece() -> tuple:
        return key, start, ",".join(ids), None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["key", "start", "ids", "digest"])

    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    rows.append((key, start, None, hashlib.sha256(",".join(ids).encode()).digest()) if whole else piece())
                whole, key, ids, size, start = key is not None, k, [], 0, c
            elif size >= CHUNK:
                rows.append(piece())
                whole, ids, size, start = False, [], 0, c
            ids.append(text := str(c))
            size += len(text) + 1
            if len(rows) >= 1000:
                yield batch()
                rows = []
    if key is not None:
        rows.append(piece())
        yield batch()


def _streamed(batches) -> Iterator[pa.RecordBatch]:
    """One digest for each key of sorted pieces."""
    key, sha = None, None
    for b in batches:
        done = []
        for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k == key:
                sha.update(b"," + ids.encode())
            else:
                done += [(key, sha.digest())] if sha else []
                key, sha = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.binary()) for i in (0, 1)], names=["key", "digest"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (key, sha.digest())], names=["key", "digest"])


def end_hashes(members: DataFrame) -> DataFrame:
    """key and the SHA-256 of its comma-joined ids in ascending order, of members(key, conv_id)."""
    dealt = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = stored(dealt.select("key", "conv_id").mapInArrow(_runs, "key binary, start bigint, ids string, digest binary"))
    pieces = runs.filter("digest is null").repartition("key").sortWithinPartitions("key", "start")
    return runs.filter("digest is not null").select("key", "digest").unionByName(pieces.select("key", "ids").mapInArrow(_streamed, "key binary, digest binary"))


# one shard


class SearchTree:
    """A ternary search tree over sequences of integers; node 0 is the root, and each other node stands for one prefix."""

    def __init__(self):
        self.symbol, self.low, self.high, self.down, self.up, self.depth = [-1], [0], [0], [0], [-1], [0]

    def insert(self, sequence: list[int]) -> int:
        """The node of the whole sequence."""
        symbol, low, high, down, at = self.symbol, self.low, self.high, self.down, 0
        for s in sequence:
            node, link, of = down[at], down, at
            while node and symbol[node] != s:
                link, of = (low, node) if s < symbol[node] else (high, node)
                node = link[node]
            if not node:
                link[of] = node = len(symbol)
                for column, value in ((symbol, s), (low, 0), (high, 0), (down, 0), (self.up, at), (self.depth, self.depth[at] + 1)):
                    column.append(value)
            at = node
        return at

    def insert_sorted(self, sequences: list[list[int]]) -> list[int]:
        """The nodes of sorted sequences, which are inserted median first."""
        ends, todo = [0] * len(sequences), deque([(0, len(sequences))])
        while todo:
            begin, end = todo.popleft()
            if begin < end:
                mid = (begin + end) // 2
                ends[mid] = self.insert(sequences[mid])
                todo += [(begin, mid), (mid + 1, end)]
        return ends

    def way(self, node: int) -> list[int]:
        """The nodes from the root to node."""
        out = [node]
        while out[-1]:
            out.append(self.up[out[-1]])
        return out[::-1]


NODE = "shard int, side int, depth int, key binary, above binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, n_bytes bigint, ends binary"


def _prefix_keys(seq: bytes) -> list[bytes]:
    sha, out = hashlib.sha256(), []
    for at in range(0, len(seq), RECORD):
        out.append(sha.copy().digest())
        sha.update(seq[at : at + RECORD])
    return [*out, sha.digest()]


def _shard(batches) -> Iterator[pa.RecordBatch]:
    """NODE rows of the sorted distinct conversations (seq, n, first, ends) of a partition; side is null for inner nodes."""
    held = list(batches)
    seqs = [x for b in held for x in b.column(0).to_pylist()]
    if not seqs:
        return
    counts, firsts = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2))
    digests = [x for b in held for x in b.column(3).to_pylist()]
    shard = TaskContext.get().partitionId()
    records = np.frombuffer(b"".join(seqs), dtype=np.uint8).reshape(-1, RECORD)
    codes = np.unique(np.ascontiguousarray(records[:, :DIGEST]).view(f"S{DIGEST}").ravel(), return_inverse=True)[1]
    text_bytes = np.ascontiguousarray(records[:, DIGEST:]).view(">i8").ravel()
    size_of = np.zeros(len(records) + 1, dtype=np.int64)  # the last is the root's
    size_of[codes] = text_bytes
    codes, tree, at, sequences = codes.tolist(), SearchTree(), 0, []
    for s in seqs:
        n = len(s) // RECORD
        sequences.append(codes[at : at + n])
        at += n
    ends = tree.insert_sorted(sequences)
    n_nodes, up, depth, symbol = len(tree.symbol), np.array(tree.up), np.array(tree.depth), np.array(tree.symbol)
    n_convs, first, leaves, saved, kids = np.zeros(n_nodes, np.int64), np.full(n_nodes, np.iinfo(np.int64).max), np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
    n_convs[ends], first[ends] = counts, firsts
    sizes = size_of[symbol]
    left, right = tree.way(ends[0]), tree.way(ends[-1])
    edge = np.zeros(n_nodes, dtype=bool)
    edge[left + right] = True
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])[::-1]
    for level in levels[:-1]:
        np.add.at(n_convs, up[level], n_convs[level])
        np.minimum.at(first, up[level], first[level])
    for level in levels:
        own = level[~edge[level]]  # what edges add is known when they are merged
        leaves[own] += kids[own] == 0
        saved[own] += (n_convs[own] - 1) * sizes[own]
        for to, what in ((kids, np.ones(len(own), np.int64)), (leaves, leaves[own]), (saved, saved[own])):
            np.add.at(to, up[own], what)
    end_of = dict(zip(ends, digests, strict=True))
    keys = {}
    for way, seq in ((left, seqs[0]), (right, seqs[-1])):
        keys |= zip(way, _prefix_keys(seq), strict=True)
    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in NODE.split(", ")])
    shared = set(left)
    rows = []
    for side, way in ((0, left), (1, right)) if ends[0] != ends[-1] else ((0, left),):
        for d, v in enumerate(way):
            again = side and v in shared  # counted on the left way
            values = (None, 0, 0, 0, 0, None) if again else (int(first[v]), int(n_convs[v]), int(kids[v]), int(leaves[v]), int(saved[v]), end_of.get(v))
            rows.append((shard, side, d, keys[v], keys[way[d - 1]] if d else None, values[0], None, *values[1:5], int(sizes[v]), values[5]))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    inner = np.flatnonzero(~edge)
    for at in range(0, len(inner), 10_000):
        v = inner[at : at + 10_000]
        under, n = edge[up[v]], len(v)
        above = [keys[u] if e else None for u, e in zip(up[v].tolist(), under.tolist(), strict=True)]
        columns = [pa.array([shard] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(depth[v].astype(np.int32)), pa.nulls(n, pa.binary()), pa.array(above, pa.binary()), pa.array(first[v]), pa.array(first[up[v]], mask=under)]
        columns += [pa.array(x[v]) for x in (n_convs, kids, leaves, saved)] + [pa.array(sizes[v]), pa.array([end_of.get(x) for x in v.tolist()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _merged_edges(edges: DataFrame) -> DataFrame:
    """One row for each node of edges, which are NODE rows: its key and columns, over all shards."""
    least = [F.max(c).alias(c) for c in ("depth", "above", "n_bytes", "ends")] + [F.min("conv_id").alias("conv_id"), F.min(F.struct("shard", "side")).alias("owner")]
    nodes = edges.groupBy("key").agg(*least, *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    below = nodes.filter("depth > 0").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    with scratch(edges.sparkSession) as paths:
        nodes = stored(nodes.withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("n_bytes")))
        return kept_by(paths, _summed(edges, nodes))


def _summed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with the sums over their subtrees, and their parents' conv_id."""
    # each node's own sums go up one way, its owner's
    ways = edges.select("shard", "side", "depth", "key").join(nodes.select("key", "owner", "n_leaves", "saved"), "key")
    mine = F.col("owner") == F.struct("shard", "side")
    upward = W.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    summed = ways.select("key", *[F.sum(F.when(mine, F.col(c)).otherwise(0)).over(upward).alias(c) for c in ("n_leaves", "saved")])
    total = summed.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    parents = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.drop("n_leaves", "saved", "owner", "n_bytes").join(total, "key").join(parents, "above", "left")


def prefix_trie(members: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of members(conv_id, seq): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node."""
    with scratch(members.sparkSession) as paths:
        keyed = stored(members.select("conv_id", F.unhex(F.sha2("seq", 256)).alias("key"), "seq"))
        distinct = keyed.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
        hashed = distinct.withColumn("key", F.unhex(F.sha2("seq", 256))).join(end_hashes(keyed.select("key", "conv_id")), "key")
        rows = stored(hashed.select("seq", "n", "first", F.col("digest").alias("ends")))
        turns = rows.agg(F.sum(F.octet_length("seq"))).first()[0] or 0
        dealt = rows.repartitionByRange(max(1, turns // (RECORD * shard_turns) + 1), "seq").sortWithinPartitions("seq")
        nodes = kept_by(paths, dealt.mapInArrow(_shard, NODE))
    edges = nodes.filter("side is not null")
    whole = _merged_edges(edges)
    own = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    inner = nodes.filter("side is null")
    near = edges.select("shard", "key").distinct().join(whole.select("key", F.col("conv_id").alias("met")), "key").select("shard", F.col("key").alias("above"), "met")
    under = inner.filter("above is not null").join(near, ["shard", "above"]).withColumn("parent_conv_id", F.col("met"))
    found = inner.filter("above is null").select(own).unionByName(under.select(own)).unionByName(whole.select(own))
    kinds = [F.col(c).cast("long").alias(c) for c in own[:-2]] + [F.col("saved").cast("long").alias("saved_tokens")]
    return found.select(*kinds, F.coalesce(F.lower(F.hex("ends")), F.lit(EMPTY)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(stored(recorded(table(spark, sf_dir, "conversations")))))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {
    "op13_prefix_trie": r"""with own as (select conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) s
    from conversations where conv_id is not null group by conv_id),
    t as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) v),
    h as (select conv_id, s, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1])), 4294967295) % 9 as h from own, t),
    r as (select a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) as s from h a left join own b on b.conv_id = a.conv_id - a.conv_id % 5),
    p as (select conv_id, s[1:d] as p, d, len(s) = d as ends from (select conv_id, s, unnest(range(0, len(s) + 1)) as d from r)),
    n as (select p, d, min(conv_id) as conv_id, count(*) as n, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends from p group by p, d),
    k as (select a.*, (select count(*) from n b where b.d = a.d + 1 and b.p[1:a.d] = a.p) as kids, case when a.d = 0 then 0 else (a.n - 1) * strlen(a.p[a.d].t) end as own from n a),
    up as (select conv_id as leaf, p[1:e] as p, kids, own from (select *, unnest(range(0, d + 1)) as e from k)),
    u as (select p, count(*) filter (where kids = 0) as leaves, sum(own) as saved from up group by p)
    select k.conv_id, k.d::bigint as depth, q.conv_id as parent_conv_id, k.n as n_convs, k.kids as n_children, u.leaves as n_leaves, u.saved::bigint as saved_tokens, k.ends as ends_sha256
    from k join u on k.p = u.p left join n q on q.d = k.d - 1 and q.p = k.p[1:k.d - 1]"""
}
