"""Pairs of vectors and captions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medcorpus.functions.scoring import latin_tokens
from medcorpus.operators.blooms import Bloom, bloom_of
from medcorpus.storage import short_lived_shuffles, spread, stored

#: Vectors of one side that a task holds at most, and rows of similarities that it has at a time.
BLOCK, CHUNK = 16_384, 512


def dot(a: Column, b: Column) -> Column:
    """The dot product of two vectors, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def grid_side(n: int, tasks: int, block: int = BLOCK) -> int:
    """Blocks of a side, so that the grid has a cell for each task, and no block over block vectors on average; small tables have fewer."""
    return max(1, -(-n // block), min(math.isqrt(max(1, tasks - 1)) + 1, n // CHUNK))


def retrieval_ranks(pairs: DataFrame, key: str = "id", block: int = BLOCK, tasks: int | None = None) -> DataFrame:
    """key, rank_ab, rank_ba: how many others score strictly more than the true partner, each way.

    The pairs form a grid of blocks of a by blocks of b. A task multiplies a cell, CHUNK rows at a time, and returns only counts, so
    similarities are never rows. Ranks are exact and take every pair; each vector is sent to the cells of its row or column, 2 * n * side
    vectors in all, where the side follows the number of tasks and, beyond that, the memory of one.
    """
    side = grid_side(pairs.count(), tasks or pairs.sparkSession.sparkContext.defaultParallelism, block)
    own = pairs.select(F.col(key).alias("id"), "a", "b", dot(F.col("a"), F.col("b")).alias("s"), F.pmod(F.xxhash64(key), F.lit(side)).cast("int").alias("blk"))
    others = F.sequence(F.lit(0), F.lit(side - 1))
    left = own.select("id", F.col("a").alias("v"), "s", F.lit(0).alias("side"), F.col("blk").alias("i"), F.explode(others).alias("j"))
    right = own.select("id", F.col("b").alias("v"), "s", F.lit(1).alias("side"), F.explode(others).alias("i"), F.col("blk").alias("j"))

    def count(p: pd.DataFrame) -> pd.DataFrame:
        x, y = p[p["side"] == 0], p[p["side"] == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "ab": [], "ba": []})
        matrix = lambda v: np.stack(v.to_numpy()).astype(np.float64)
        a, b = matrix(x["v"]), matrix(y["v"]).T
        least_a, least_b = x["s"].to_numpy() + 1e-12, y["s"].to_numpy() + 1e-12
        ids, other = x["id"].to_numpy(), y["id"].to_numpy()
        ab, ba = np.empty(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        for k in range(0, len(x), CHUNK):
            part = slice(k, k + CHUNK)
            sim, differ = a[part] @ b, ids[part, None] != other[None]
            ab[part] = ((sim > least_a[part, None]) & differ).sum(axis=1)
            ba += ((sim > least_b[None]) & differ).sum(axis=0)
        return pd.DataFrame({"id": np.concatenate([ids, other]), "ab": np.concatenate([ab, 0 * ba]), "ba": np.concatenate([0 * ab, ba])})

    counts = left.unionByName(right).groupBy("i", "j").applyInPandas(count, "id long, ab long, ba long")
    return counts.groupBy("id").agg(F.sum("ab").alias("rank_ab"), F.sum("ba").alias("rank_ba")).withColumnRenamed("id", key)


def recall_at(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Shares of partners among the k best, each way, and that of chance."""
    cols = [F.avg((F.col(f"rank_{w}") < k).cast("double")).alias(f"{w}_r{k}") for w in ("ab", "ba") for k in ks]
    return ranks.agg(F.count("*").alias("n"), *cols, (1.0 / F.count("*")).alias("chance"))


def mismatched_mean(pairs: DataFrame) -> DataFrame:
    """The mean similarity of all pairs that do not belong together, from the sums of the vectors."""
    dims = pairs.select(F.posexplode(F.arrays_zip("a", "b")).alias("d", "v")).groupBy("d").agg(F.sum(F.col("v.a").cast("double")).alias("a"), F.sum(F.col("v.b").cast("double")).alias("b"))
    both = dims.agg(F.sum(F.col("a") * F.col("b")).alias("all"))
    own = pairs.agg(F.count("*").alias("n"), F.sum(dot(F.col("a"), F.col("b"))).alias("diag"))
    # two tables of one row
    return own.join(both).select("n", ((F.col("all") - F.col("diag")) / (F.col("n") * F.col("n") - F.col("n"))).alias("mean"))


def rouge_l(pred: Column, refs: Column, beta: float = 1.2) -> Column:
    """The best longest-common-subsequence F of a prediction's tokens over references."""

    @F.pandas_udf("double")
    def score(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([max((_lcs_f(list(a), list(b), beta) for b in bs), default=0.0) for a, bs in zip(p, r, strict=True)])

    return score(latin_tokens(pred), F.transform(refs, latin_tokens))


def _lcs_f(a: list[str], b: list[str], beta: float) -> float:
    if not a or not b:
        return 0.0
    # the row of common subsequence lengths as bits: one bit for each step up
    places: dict[str, int] = {}
    for k, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << k
    row = (1 << len(b)) - 1
    full = row
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    n = len(b) - row.bit_count()
    p, r = n / len(a), n / len(b)
    return (1 + beta**2) * p * r / (r + beta**2 * p) if n else 0.0


#: Items whose grams a task holds at a time, and items whose references' grams it counts at a time.
ITEMS, CITED = 256, 1024
#: Grams whose numbers go to every task, those of the most items; the others' are joined.
HOT = 1 << 21
#: Rows of a block, and repeated grams of a range, about.
BLOCK_ROWS, RANGE = 512, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def _flat(column: pa.Array, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each list begins and ends among them."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), (offsets - offsets[0]).astype(np.int64)


def _levels(hashes: np.ndarray, lengths: np.ndarray, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to max_n the grams of texts of so many tokens: those that begin at each place, and whether they end inside the place's text."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(hashes))  # tokens up to the text's end
    state = np.zeros(len(hashes), dtype=np.uint64)
    for n in range(1, max_n + 1):
        state = _mixed(state[: max(0, len(hashes) - n + 1)] + hashes[n - 1 :])
        # two bits of a gram's hash say how long it is
        yield (state & ~np.uint64(3)) | np.uint64(n - 1), left[: len(state)] >= n


def _cited(batches, n: int, shorter: Bloom | None) -> Iterator[pa.RecordBatch]:
    """Of (tokens' hashes of each reference) of items the grams of n tokens, and how many items have each; only those whose two grams of n - 1 tokens may be in shorter."""
    for batch in batches:
        for at in range(0, batch.num_rows, CITED):
            lists = batch.column(0).slice(at, CITED)
            refs = lists.flatten()
            hashes, ends = _flat(refs)
            *before, (gram, whole) = _levels(hashes.view(np.uint64), np.diff(ends), n)
            if shorter is not None:
                often = np.zeros(len(before[-1][0]), dtype=bool)
                often[shorter.where(before[-1][0])] = True
                whole = whole & often[:-1] & often[1:]
            of_ref = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            item = np.repeat(of_ref, np.diff(ends))[: len(gram)][whole]
            gram = gram[whole]
            order = np.argsort(gram, kind="stable")  # items stay in order
            gram, item = gram[order], item[order]
            new = np.ones(len(gram), dtype=bool)
            new[1:] = (gram[1:] != gram[:-1]) | (item[1:] != item[:-1])
            own, count = np.unique(gram[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(count.astype(np.int64))], names=["gram", "n"])


def _grams(b: pa.RecordBatch, max_n: int) -> list[pa.Array]:
    """Of (item, tokens' hashes of the prediction, and of each reference) the item, its number of references, its texts' lengths, the distinct grams of all texts, and (place of the gram, text, count) of each text that has it. Text 0 is the prediction."""
    items = b.num_rows
    said, said_ends = _flat(b.column(1))
    refs = b.column(2).flatten()
    cited, cited_ends = _flat(refs)
    ends = b.column(2).offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    k = np.diff(ends)
    # predictions first, then all references
    hashes = np.concatenate([said, cited]).view(np.uint64)
    lengths = np.concatenate([np.diff(said_ends), np.diff(cited_ends)])
    item_of = np.concatenate([np.arange(items), np.repeat(np.arange(items), k)])
    text_of = np.concatenate([np.zeros(items, np.int64), 1 + np.arange(k.sum()) - np.repeat(ends[:-1], k)])
    where = np.repeat(np.arange(len(lengths)), lengths)
    found = [(where[: len(g)][whole], g[whole].view(np.int64)) for g, whole in _levels(hashes, lengths, max_n)]
    text, gram = (np.concatenate(x) for x in zip(*found, strict=True))
    item, text = item_of[text], text_of[text]
    order = np.lexsort((text, gram, item))
    item, gram, text = item[order], gram[order], text[order]
    new_gram = np.ones(len(item), dtype=bool)
    new_gram[1:] = (item[1:] != item[:-1]) | (gram[1:] != gram[:-1])
    new = new_gram.copy()
    new[1:] |= text[1:] != text[:-1]
    first, heads = np.flatnonzero(new), np.flatnonzero(new_gram)
    counts, place = np.diff(np.append(first, len(item))), np.cumsum(new_gram) - 1
    lists = lambda own, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=items))]).astype(np.int32)), pa.array(values))
    begins = np.concatenate([[0], np.cumsum(np.bincount(item[heads], minlength=items))])
    inside = place[first] - begins[item[first]]
    sizes = np.lexsort((text_of, item_of))
    arrays = [b.column(0), pa.array(k.astype(np.int32)), lists(item_of, lengths[sizes].astype(np.int32)), lists(item[heads], gram[heads])]
    return arrays + [lists(item[first], x.astype(np.int32)) for x in (inside, text[first], counts)]


def _in_slices(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ITEMS):
            yield batch.slice(at, ITEMS)


def _scores(b: pa.RecordBatch, max_n: int, sigma: float | None, weigh: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """item and score of (item, prediction, references); weigh: the weights of grams."""
    items, counts, *rest = _grams(b, max_n)
    (lens, of_len), (gram, of_gram), (place, of_place), (text, _), (n, _) = map(_flat, rest)
    weights, scores = weigh(gram), np.zeros(b.num_rows)
    for i, k in enumerate(counts.to_pylist()):
        mine, entry = (slice(o[i], o[i + 1]) for o in (of_gram, of_place))
        own, p, t, c, weight = gram[mine], place[entry], text[entry], n[entry], weights[mine]
        if not k or not len(own):
            continue
        said = np.zeros(len(own), dtype=np.int64)
        said[p[t == 0]] = c[t == 0]
        cell, w = (own & 3)[p] * (k + 1) + t, weight[p]
        sums = lambda x: np.bincount(cell, weights=x, minlength=4 * (k + 1)).reshape(4, k + 1)
        square, dot_ = sums((c * w) ** 2), sums(np.minimum(said[p], c) * c * w * w)
        if sigma is not None:
            gap = lens[of_len[i] : of_len[i + 1]].astype(np.float64)
            dot_ = dot_ * np.exp(-((gap - gap[0]) ** 2) / (2 * sigma**2))
        norm = np.sqrt(square[:, 1:] * square[:, :1])
        cos = np.divide(dot_[:, 1:], norm, out=np.zeros_like(norm), where=norm > 0)
        scores[i] = cos.sum() * 10 / max_n / k
    return pa.RecordBatch.from_arrays([items, pa.array(scores)], names=["item", "cider"])


def _packed(x: np.ndarray) -> bytes:
    """64-bit numbers as all their first bytes, then all second ones and so on: high bytes that are zero lie side by side, and take no room when compressed."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def _asked(b: pa.RecordBatch, n: int, seen: Bloom) -> np.ndarray:
    """In order the distinct grams of n tokens that may be in seen, of all texts of rows (item, prediction, references)."""
    said, said_ends = _flat(b.column("p"))
    cited, cited_ends = _flat(b.column("r").flatten())
    *_, (gram, whole) = _levels(np.concatenate([said, cited]).view(np.uint64), np.concatenate([np.diff(said_ends), np.diff(cited_ends)]), n)
    gram = gram[whole]
    return np.unique(gram[seen.where(gram)].view(np.int64))


def _runs(batches) -> Iterator[tuple[pa.RecordBatch, int, int, int, int]]:
    """Rows (item, p, r, file, id) that lie side by side in a block, with their file, block, and first and last id."""
    for batch in batches:
        if batch.num_rows:
            file, ids = (batch.column(c).to_numpy() for c in ("file", "id"))
            block = ids // BLOCK_ROWS
            starts = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (ids[1:] != ids[:-1] + 1) | (block[1:] != block[:-1])))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
                yield batch.slice(at, end - at), file[at], block[at], ids[at], ids[end - 1]


def _questions(batches, n: int, seen: Bloom, bits: int) -> Iterator[pa.RecordBatch]:
    """What rows ask for: by range of grams the grams, as differences. first and last say which rows of the block ask."""
    names = ["part", "file", "block", "first", "last", "n", "gram"]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    for run, *place in _runs(batches):
        gram = _asked(run, n, seen)
        if len(gram):
            part = gram >> (64 - bits)
            heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            rows = [(part[i], *place, n, _packed(np.diff(own, prepend=np.uint64(0)))) for i, own in zip(heads, np.split(gram.view(np.uint64), heads[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _spelled(b: pa.RecordBatch, spell: Callable[[np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """Rows with other numbers for their tokens; spell: of all of them, in order."""
    said, said_ends = _flat(b.column("p"))
    cited, cited_ends = _flat(b.column("r").flatten())
    new = spell(np.concatenate([said, cited]))
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
    refs = b.column("r").offsets.to_numpy()
    arrays = [b.column("item"), lists(said_ends, pa.array(new[: len(said)])), lists(refs - refs[0], lists(cited_ends, pa.array(new[len(said) :]))), b.column("id")]
    return pa.RecordBatch.from_arrays(arrays, names=["item", "p", "r", "id"])


def _boxes(batches) -> Iterator[pa.RecordBatch]:
    """Rows as one value for each run of them, with tokens as numbers of the run's words: hashes take no less room when they are compressed."""
    for run, file, block, *_ in _runs(batches):
        words = []

        def spell(tokens: np.ndarray, words=words) -> np.ndarray:
            own, at = np.unique(tokens, return_inverse=True)
            words.append(own)
            return at.astype(np.int32)

        own, out = _spelled(run, spell), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(own)
        values = [[file], [block], [out.getvalue().to_pybytes()], [words[0].tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, kinds, strict=True)], names=["file", "block", "rows", "words"])


def _unboxed(boxes: pa.Table) -> pa.RecordBatch:
    """The rows of a block's runs, in order."""
    found = []
    for x, words in zip(boxes.column("rows").to_pylist(), boxes.column("words").to_pylist(), strict=True):
        own = np.frombuffer(words, np.int64)
        found += [_spelled(b, lambda at, own=own: own[at]) for b in pa.ipc.open_stream(x)]
    return pa.Table.from_batches(found).sort_by("id").combine_chunks().to_batches()[0]


def _answers(asked: pa.Table, often: pa.Table) -> pa.Table:
    """The questions with df in the place of grams: 1 of those that are not often."""
    gram, df = (often.column(c).to_numpy() for c in ("gram", "df"))
    order = np.argsort(gram)
    gram, df = np.append(gram[order], 0), np.append(df[order], 1)
    found = []
    for x in asked.column("gram").to_pylist():
        own = np.cumsum(_unpacked(x), dtype=np.uint64).view(np.int64)
        at = np.searchsorted(gram[:-1], own)
        found.append(_packed(np.where(gram[at] == own, df[at], 1)))
    return asked.drop_columns(["gram"]).append_column("df", pa.array(found, pa.binary()))


def _known(b: pa.RecordBatch, answers: pa.Table, seen: list[Bloom]) -> tuple[np.ndarray, np.ndarray]:
    """The grams that a block's rows, in order of id, asked for, and their df."""
    ids, grams, dfs, own = b.column("id").to_numpy(), [], [], {}
    for n, first, last, part, df in zip(*[answers.column(c).to_pylist() for c in ("n", "first", "last", "part", "df")], strict=True):
        own.setdefault((n, first, last), []).append((part, df))
    for (n, first, last), parts in own.items():
        at = np.searchsorted(ids, first)
        grams.append(_asked(b.slice(at, np.searchsorted(ids, last, "right") - at), n, seen[n - 1]))
        dfs.append(np.concatenate([_unpacked(df) for _, df in sorted(parts)]))
        if len(grams[-1]) != len(dfs[-1]):
            raise ValueError("a block's rows do not ask for what was answered")
    gram, first = np.unique(np.concatenate([np.zeros(0, np.int64), *grams]), return_index=True)
    return gram, np.concatenate([np.zeros(0, np.uint64), *dfs])[first]


def _weights(total: int, *tables: tuple[np.ndarray, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """Weights of grams by tables of (gram, in order, and df); a gram in none has that of one item."""
    full = np.log(float(max(1, total)))

    def weigh(gram: np.ndarray) -> np.ndarray:
        weights = np.full(len(gram), full)
        for own, df in tables:
            if len(own):
                spot = np.minimum(np.searchsorted(own, gram), len(own) - 1)
                known = own[spot] == gram
                weights[known] = full - np.log(df[spot[known]].astype(np.float64))
        return weights

    return weigh


def repeated_grams(refs: DataFrame, max_n: int) -> DataFrame:
    """gram, df of the grams that the references of several items have; refs holds tokens' hashes, a list of lists an item.

    Grams grow by one token a round: one that several items have begins and ends with one that several have, so all others are left out
    where they lie, by a Bloom filter of the round before, and only what may be repeated is moved.
    """
    out, shorter = [], None
    for n in range(1, max_n + 1):
        counted = refs.mapInArrow(lambda it, n=n, shorter=shorter: _cited(it, n, shorter), "gram long, n long")
        with short_lived_shuffles(refs.sparkSession):
            own = stored(counted.groupBy("gram").agg(F.sum("n").alias("df")).filter("df > 1"))
        shorter = bloom_of(own, "gram", own.count())
        out.append(own)
    return reduce(DataFrame.unionByName, out)


def _hot(often: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The least df of which at most so many grams have that much or more, and those grams in order with their df."""
    least, room = None, most
    for r in often.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("df")).toLocalIterator():
        room -= r["n"]
        if room < 0:
            break
        least = r["df"]
    if least is None:
        return 1 << 62, np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = often.filter(F.col("df") >= least).toArrow()
    gram, df = (found.column(c).to_numpy() for c in ("gram", "df"))
    order = np.argsort(gram)
    return least, gram[order], df[order].astype(np.int32 if len(df) and df.max() < 1 << 31 else np.int64)


def cider(captions: DataFrame, max_n: int = 4, sigma: float | None = None, hot: int = HOT) -> DataFrame:
    """item, cider of captions(item, pred, refs): clipped tf-idf cosine of 1- to 4-grams, mean over references.

    Only the tokens, as 64-bit hashes, are stored; an item's grams are made anew from them wherever they are needed. A gram that no second item's
    references have weighs log N. Of those that several have, the hot ones of the most items go to every task with their df. For the others
    a block of rows asks once, by ranges of grams; answers are the numbers in the order of the grams, which the block makes anew when it
    meets them. Bloom filters keep all else where it is. This goes by the number of tokens, so one part of it is moved at a time.

    sigma: with a Gaussian penalty of that width on the difference of the two texts' numbers of tokens; without it there is none.
    """
    if not 1 <= max_n <= 4:
        raise ValueError("grams of one to four tokens")
    kind = dict(captions.dtypes)["item"]
    hashed = lambda text: F.transform(latin_tokens(text), lambda w: F.xxhash64(w))
    tokens = captions.select("item", F.coalesce(hashed(F.col("pred")), F.array().cast("array<long>")).alias("p"), F.coalesce(F.transform("refs", hashed), F.array().cast("array<array<long>>")).alias("r"))
    rows = stored(spread(tokens))
    often = repeated_grams(rows.select("r"), max_n)
    least, gram, df = _hot(often, hot)
    rare = often.filter(F.col("df") < least)
    total = rows.select("item").distinct().count()
    out = f"item {kind}, cider double"
    # the two low bits of a gram say how long it is
    levels = {n: k for n, k in rare.groupBy((F.col("gram").bitwiseAND(3) + 1).alias("n")).count().collect()}
    if not levels:
        return rows.mapInArrow(lambda it: (_scores(b, max_n, sigma, _weights(total, (gram, df))) for b in _in_slices(it)), out)

    # a row's place in its file, which is the same whenever it is read
    placed = rows.select("item", "p", "r", F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("id"))
    seen, answers = [], []
    for n in range(1, max_n + 1):
        own, count = rare.filter(F.col("gram").bitwiseAND(3) == n - 1), levels.get(n, 0)
        seen.append(bloom_of(own, "gram", count))
        bits = max(1, max(placed.sparkSession.sparkContext.defaultParallelism, count // RANGE).bit_length())
        asked = placed.mapInArrow(lambda it, n=n, bits=bits, own_seen=seen[-1]: _questions(it, n, own_seen, bits), "part long, file long, block long, first long, last long, n int, gram binary")
        met = asked.groupBy("part").cogroup(own.withColumn("part", F.shiftright("gram", 64 - bits)).groupBy("part"))
        with short_lived_shuffles(placed.sparkSession):
            answers.append(stored(met.applyInArrow(lambda a, o: _answers(a, o), "part long, file long, block long, first long, last long, n int, df binary")))

    def scored(boxes: pa.Table, found: pa.Table) -> pa.Table:
        own = _unboxed(boxes)
        weigh = _weights(total, _known(own, found, seen), (gram, df))
        return pa.Table.from_batches([_scores(b.select(["item", "p", "r"]), max_n, sigma, weigh) for b in _in_slices([own])])

    blocks = placed.mapInArrow(_boxes, "file long, block long, rows binary, words binary").groupBy("file", "block")
    return blocks.cogroup(reduce(DataFrame.unionByName, answers).groupBy("file", "block")).applyInArrow(lambda a, o: scored(a, o), out)
