"""Near-duplicates by MinHash with sequential Bayesian verification.

1. One pass over the texts gives each document's set size, a digest of its shingle set and a signature of
   ``N_HASHES`` 8-bit values. Documents with equal sets are one class, represented by its smallest doc_id.
2. Representatives that share a band of the signature are candidates. ``BANDS`` bands of ``ROWS`` values miss
   a pair at the threshold of 0.85 with a chance of 4e-7.
3. A candidate pair's signatures are compared batch by batch; it is dropped as soon as the posterior chance that its
   similarity reaches the threshold is below ``MISS``. What survives is verified on the full shingle sets.
4. First every document is compared with one other: of the smallest doc_ids of its buckets the one it shares most
   buckets with. Buckets whose members are then one component need no more. In the others only pairs of different components count, each in the first band they
   share. The members of a bucket's largest component are dealt into blocks, so are all its other members, and
   blocks meet in pairs unless both are of the largest component: a big group of copies is read once for each block of others.
5. Where blocks meet, a pair is a candidate only if its documents share one of their rarest shingles: of n and m >= n
   shingles in one fixed order, linked documents must share one of the first n - ceil(2 * t / (1 + t) * n) + 1 and
   m - ceil(t * m) + 1, where t is the threshold. The order is by how often a shingle occurs among these documents
   (counted in ``SLOTS`` hash slots, whatever their number). So text that many documents share makes no candidates. Then the
   signatures are compared, and what passes must have enough 16-bit hashes of shingles in common, which are never fewer than
   the common shingles; so neither check loses a link. Of each two components the most similar pairs are
   verified first; buckets with more than those are gone through once more, with all pairs, if they are still of several components.

So the number of verified pairs does not grow with the square of a group of copies that are all alike, nor with that of a
group that only shares a frequent passage. Where a bucket's other members fill more than one block, those are left out first that share
no rare shingle with another component there, which takes their ids and rare shingles alone: a bucket of documents that are not
alike enough goes to no block at all. What is left to grow with the square of a bucket, divided by ``BLOCK``, are the rows of members that
do share rare shingles outside its largest component. Nothing is capped. Shingles are held as 64-bit hashes: two different shingles of
one document and another are taken for one with a chance of 2e-20 a pair, 2e-9 for any two of 1e5 in a pair of documents.

Cases: a null or empty text or one of white space has an empty set and is linked with nothing; fewer words than a
shingle are one shingle; repeated rows are one class; rows with one doc_id and different texts are linked; a null doc_id is linked with
nothing and has a null component; a very long text costs its set once for each pair it is verified in; ids must be integers;
an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medcorpus.llm.bitmaps import may_be_in
from medcorpus.llm.common import saved, sliced, small_batches, stored, table
from medcorpus.llm.components import components
from medcorpus.llm.shingles import MinHasher, set_digest, shingle_set

N_HASHES, BANDS, ROWS = 512, 25, 5
BATCH = 64
MISS = 1e-4
#: Members of a bucket that a task compares with as many others at once, and what they may hold.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Hash slots in which the shingles of mixed buckets are counted.
SLOTS = 1 << 18
#: Pairs whose signatures are compared at once.
SLICE = 100_000
#: Best pairs of two components that are verified before all others.
FIRST = 2


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches among n values at which the similarity reaches threshold with a chance of miss or more.

    With a uniform prior the posterior after m matches is Beta(m + 1, n - m + 1); its mass above t is that of a
    binomial of n + 1 trials up to m.
    """
    mass = 0.0
    for m in range(n + 1):
        mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if mass >= miss:
            return m
    return n


def _sign(batches, size: int):
    hasher = MinHasher(N_HASHES)
    for batch in sliced(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingle_set(text, size)
            rows.append((doc, len(s), set_digest(s) if len(s) else None, hasher.sign(s) if len(s) else None))
            if len(rows) == 2000:
                yield _batch(rows, batch.schema.field(0).type)
                rows = []
        if rows:
            yield _batch(rows, batch.schema.field(0).type)


def _batch(rows, kind):
    types = (kind, pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n", "digest", "sig"])


class Verifier:
    """Sequential comparison of signatures."""

    def __init__(self, threshold: float, miss: float):
        self.least = [(n, least_matches(n, threshold, miss)) for n in range(BATCH, N_HASHES + 1, BATCH)]

    def survivors(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of rows i of a and j of b that no batch rules out, and their matches."""
        parts = [self._part(a, b, i[at : at + SLICE], j[at : at + SLICE]) for at in range(0, max(1, len(i)), SLICE)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def _part(self, a, b, i, j):
        found = np.zeros(len(i), dtype=np.int64)
        for n, least in self.least:
            found = found + (a[i, n - BATCH : n] == b[j, n - BATCH : n]).sum(axis=1)
            keep = found >= least
            i, j, found = i[keep], j[keep], found[keep]
        return i, j, found


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), N_HASHES)


def _prune(batches, threshold: float, miss: float):
    """Rows (a, b, sig_a, sig_b) -> the pairs that survive."""
    verifier = Verifier(threshold, miss)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = _signatures(batch.column(2).to_pylist()), _signatures(batch.column(3).to_pylist())
        every = np.arange(batch.num_rows)
        kept = verifier.survivors(a, b, every, every)[0]
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(kept)) for k in (0, 1)], names=["a", "b"])


def _counts(batches):
    """Rows (id, set) -> how often a task's shingles fall into each slot."""
    total = np.zeros(SLOTS, dtype=np.int64)
    for batch in batches:
        for x in batch.column(1):
            total += np.bincount((np.frombuffer(x.as_py(), dtype=np.uint64) >> np.uint64(32)).astype(np.int64) % SLOTS, minlength=SLOTS)
    slots = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(total[slots])], names=["slot", "n"])


def rarest(shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """So many of the rarest shingles that a document of the wanted similarity must share one of its own with them."""
    n = len(shingles)
    order = np.lexsort((shingles, counts[(shingles >> np.uint64(32)).astype(np.int64) % SLOTS]))
    return shingles[order[: n + 1 + -percent * n // 100]].astype(np.uint32)


def _rarest_of(batches, counts: np.ndarray, percent: int):
    for batch in sliced(batches):
        sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(1).to_pylist()]
        rare, low = [rarest(x, counts, percent).tobytes() for x in sets], [x.astype(np.uint16).tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rare, type=pa.binary()), pa.array(low, type=pa.binary())], names=["id", "rare", "low"])


def _flat_rare(batches):
    """(id, rare) -> a row for each rare shingle."""
    for batch in batches:
        values = batch.column(1).to_pylist()
        ids = np.repeat(np.arange(batch.num_rows), [len(x) // 4 for x in values])
        shingles = np.frombuffer(b"".join(values), dtype=np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(shingles)], names=["id", "shingle"])


def that_can_meet(at: DataFrame, rare: DataFrame) -> DataFrame:
    """Rows of at(bucket, id, component, ...) that share a rare shingle with another component in their bucket: all that a link could be with.

    Only ids and shingles are moved; rare(id, rare).
    """
    each = rare.join(at.select("id").distinct(), "id", "left_semi").select("id", "rare").mapInArrow(_flat_rare, "id bigint, shingle bigint")
    cells = at.select("bucket", "id", "component").join(each, "id")
    met = cells.groupBy("bucket", "shingle").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
    alive = stored(cells.join(stored(met.select("bucket", "shingle")), ["bucket", "shingle"], "left_semi").select("bucket", "id").distinct())
    return at.join(alive, ["bucket", "id"], "left_semi")


def sharing(rare: list[bytes], n: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of n shingles that share a rare one: of rows of side 0 with those of side 1, or of all if there is no side 1."""
    sizes = np.array([len(x) // 4 for x in rare])
    owner = np.repeat(np.arange(len(rare)), sizes)
    value = np.frombuffer(b"".join(rare), dtype=np.uint32)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # the shorter document of a pair shares one of its very rarest
    very = place < (n + 1 + -2 * percent * n // (100 + percent))[owner]
    order = np.lexsort((owner, value))
    owner, value, very = owner[order], value[order], very[order]
    begin = np.flatnonzero(np.diff(value, prepend=~value[:1]))
    length = np.diff(begin, append=len(value))
    meets = np.zeros((len(rare),) * 2, dtype=bool)
    for x, y in ((0, 1), (1, 0)):
        two = begin[length == 2]
        two = two[very[two + x]]
        meets[owner[two + x], owner[two + y]] = True
    for at, k in zip(begin[length > 2].tolist(), length[length > 2].tolist(), strict=True):
        own = owner[at : at + k]
        meets[own[very[at : at + k]][:, None], own] = True
    meets &= n[:, None] <= n
    meets |= meets.T
    if side.any():
        return np.nonzero(meets & (side[:, None] == 0) & (side == 1))
    return np.nonzero(np.triu(meets, 1))


def can_be_linked(low: list[bytes], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of rows i and j, those whose 16-bit hashes of shingles have enough in common."""
    values = [np.frombuffer(x, dtype=np.uint16) for x in low]
    n = np.array(list(map(len, values)))
    most = np.empty(len(i), dtype=np.int64)
    for x, y in ((i, j), (j, i)):
        order = np.argsort(x, kind="stable")
        begin = np.flatnonzero(np.diff(x[order], prepend=-1))
        for at, end in zip(begin, [*begin[1:], len(order)], strict=True):
            own, others = x[order[at]], y[order[at:end]]
            held = np.zeros(1 << 16, dtype=bool)
            held[values[own]] = True
            sizes = n[others]
            found = np.add.reduceat(held[np.concatenate([values[k] for k in others])], np.cumsum(sizes) - sizes)
            most[order[at:end]] = found if x is i else np.minimum(most[order[at:end]], found)
    return (100 + percent) * most >= percent * (n[i] + n[j])


def _block_pairs(batches, percent: int, miss: float, first: int):
    """Rows sorted by group (pair of blocks of a bucket): group, band, side, id, component, n, sig, rare, low, bucket -> surviving pairs across components.

    first: of each two components only so many pairs, the most similar, and a row with the bucket if there are more; 0: all.
    """
    threshold, held, key = percent / 100, [], None
    verifier = Verifier(threshold, miss)

    def pairs(rows: list[tuple]):
        if len({r[4] for r in rows}) < 2:
            return []
        band = rows[0][1]
        ids, comp, n = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
        i, j = sharing([r[7] for r in rows], n, np.array([r[2] for r in rows]), percent)
        keep = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
        if not keep.any():
            return []
        sig = _signatures([r[6] for r in rows])
        i, j, found = verifier.survivors(sig, sig, i[keep], j[keep])
        if len(i):
            keep = can_be_linked([r[8] for r in rows], i, j, percent)
            i, j, found = i[keep], j[keep], found[keep]
        if band and len(i):
            by_band = sig[:, : BANDS * ROWS].reshape(len(rows), BANDS, ROWS)
            before = np.zeros(len(i), dtype=bool)
            for k in range(band):
                before |= (by_band[i, k] == by_band[j, k]).all(axis=1)
            i, j, found = i[~before], j[~before], found[~before]
        if first and len(i):
            order = np.lexsort((ids[j], ids[i], -found))
            seen: dict[tuple, int] = {}
            kept = []
            for k in order:
                two = (min(comp[i[k]], comp[j[k]]), max(comp[i[k]], comp[j[k]]))
                if seen.get(two, 0) < first:
                    seen[two] = seen.get(two, 0) + 1
                    kept.append(k)
            more = len(kept) < len(i)
            i, j = i[kept], j[kept]
            if more:
                return [(None, None, rows[0][9])] + both(ids, i, j)
        return both(ids, i, j)

    def both(ids, i, j):
        return [(min(x, y), max(x, y), None) for x, y in zip(ids[i].tolist(), ids[j].tolist(), strict=True)]

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found, strict=True)], names=["a", "b", "bucket"])

    found: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(10)), strict=True):
            if row[0] != key and held:
                found += pairs(held)
                held = []
                if len(found) > 5000:
                    yield out(found)
                    found = []
            key = row[0]
            held.append(row)
    found += pairs(held) if held else []
    if found:
        yield out(found)


def _sets(batches, size: int):
    for batch in sliced(batches):
        sets = [shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, type=pa.binary())], names=["id", "set"])


def _linked(batches, percent: int):
    for batch in sliced(batches):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= percent * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))


class Linker:
    """Verifies pairs of representatives on their full sets."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        sets = may_be_in(self.sets, "id", pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        both = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
        return both.mapInArrow(lambda it: _linked(it, percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of docs; linked: 100 * intersection >= percent * union."""
    small_batches(docs.sparkSession)
    threshold = percent / 100
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(base.mapInArrow(lambda it: _sign(it, shingle_words), "doc_id bigint, n bigint, digest binary, sig binary"))
    usable = signed.filter("digest is not null and doc_id is not null")
    # the place of the band is hashed too, so a bucket is of one band
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * ROWS + 1, ROWS)) for k in range(BANDS)])
    reps = stored(usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n", keys.alias("keys"))).alias("rep")))
    classes = reps.select("digest", F.col("rep.doc_id").alias("rep"))
    by_doc = usable.select("doc_id", "digest").join(classes, "digest").select("doc_id", "rep")
    twice = by_doc.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).filter("a <> b").select("a", "b")
    bands = reps.select(F.col("rep.doc_id").alias("id"), F.col("rep.n").alias("n"), F.posexplode("rep.keys").alias("band", "bucket"))
    full = stored(bands.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("leader")).filter("members > 1"))
    members = stored(may_be_in(bands, "bucket", full).join(full, "bucket"))
    needed = stored(members.select(F.col("id").alias("doc_id")).distinct())
    # one pass over the texts of documents that are in a bucket, where they lie
    sets = stored(may_be_in(base.filter("doc_id is not null"), "doc_id", needed, then=lambda it: _sets(it, shingle_words), schema="id bigint, set binary"))
    linker = Linker(sets, percent)
    sig = stored(may_be_in(usable.select(F.col("doc_id").alias("id"), "sig"), "id", needed, "doc_id"))

    # a document's leader of most buckets is the one it is most like
    star = members.filter("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("shared"))
    star = star.groupBy("id").agg(F.max(F.struct("shared", (-F.col("leader")).alias("back"))).alias("best"))
    star = stored(star.select((-F.col("best.back")).alias("a"), F.col("id").alias("b")))
    with_a = star.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
    with_b = with_a.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b")
    pruned = stored(with_b.mapInArrow(lambda it: _prune(it, threshold, miss), "a bigint, b bigint"))
    edges = saved(linker.links(pruned).unionByName(twice))
    labels = components(edges)
    checked, payload, again = star, None, None
    for first in (FIRST, 0):
        at = members.join(labels, "id", "left").select("id", "n", "band", "bucket", F.coalesce("component", "id").alias("component"))
        size = F.count("*").alias("own")
        mixed = at.groupBy("bucket", "component").agg(size, F.sum("n").alias("shingles")).groupBy("bucket")
        mixed = mixed.agg(F.max(F.struct("own", "component")).alias("top"), F.sum("own").alias("members"), F.sum("shingles").alias("shingles"), F.count("*").alias("components"))
        # a member holds its signature, its share of rarest shingles, and two bytes a shingle
        mean = F.lit(N_HASHES) + F.col("shingles") / F.col("members") * ((1 - threshold) * 4 + 2)
        most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_BYTES / mean)))
        blocks = lambda rows: F.ceil(rows / most).cast("int")
        mixed = mixed.filter("components > 1") if again is None else mixed.filter("components > 1").join(again, "bucket", "left_semi")
        mixed = saved(mixed.select("bucket", F.col("top.component").alias("top"), most.alias("most"), blocks(F.col("top.own")).alias("tops"), blocks(F.col("members") - F.col("top.own")).alias("others")))
        at = saved(at.join(mixed, "bucket"))
        if payload is None:
            own = sets.join(at.select("id").distinct(), "id", "left_semi")
            counted = own.mapInArrow(_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
            counts = np.zeros(SLOTS, dtype=np.int64)
            counts[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
            rare = own.mapInArrow(lambda it, counts=counts: _rarest_of(it, counts, percent), "id bigint, rare binary, low binary")
            payload = stored(sig.join(rare, "id"))
        at = at.withColumn("is_top", F.col("component") == F.col("top"))
        wide = at.filter("others > 1")
        if wide.limit(1).count():
            # rows would go to many blocks: those that can meet none are left out, and the rest are dealt over as many blocks as they take
            alive = saved(that_can_meet(wide, payload.select("id", "rare")).drop("tops", "others"))
            sizes = alive.groupBy("bucket").agg(F.ceil(F.count(F.when(F.col("is_top"), 1)) / F.max("most")).cast("int").alias("tops"), F.ceil(F.count(F.when(~F.col("is_top"), 1)) / F.max("most")).cast("int").alias("others"))
            alive = alive.join(sizes.filter("others > 0"), "bucket")
            at = at.filter("others <= 1").unionByName(alive)
        within = F.pmod(F.xxhash64("id"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))).cast("int")
        at = at.withColumn("own", F.when(F.col("is_top"), within).otherwise(F.col("tops") + within))
        at = at.withColumn("other", F.explode(F.sequence(F.when(F.col("is_top"), F.col("tops")).otherwise(F.lit(0)), F.col("tops") + F.col("others") - 1)))
        group = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
        at = at.select(group.alias("group"), "band", (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "component", "n", "bucket")
        at = at.join(payload, "id").select("group", "band", "side", "id", "component", "n", "sig", "rare", "low", "bucket").repartition("group").sortWithinPartitions("group")
        out = saved(at.mapInArrow(lambda it, first=first: _block_pairs(it, percent, miss, first), "a bigint, b bigint, bucket bigint"))
        again = out.filter("bucket is not null").select("bucket").distinct()
        found = saved(out.filter("a is not null").select("a", "b").distinct().join(checked, ["a", "b"], "left_anti"))
        checked = checked.unionByName(found)
        new = saved(linker.links(found))
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(new))
        if not again.limit(1).count():
            break
    final = by_doc.join(labels.withColumnRenamed("id", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLE_SQL: dict[str, str] = {}
