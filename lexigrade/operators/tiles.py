"""Alignment of pairs too long for one row: the matrix of word pairs is dealt out in tiles.

Words travel in blocks of vectors. Every block of the one side meets every block of the other, each
such tile in a group of its own, so one pair fills as many tasks as it has tiles and none holds more than two
blocks and their similarities. The two softmaxes need a maximum and a sum per word over
all its tiles: a first pass gives each tile's part, the parts are merged, and a second pass
over the tiles gives the links. The results are those of `align.with_links`. The tiles of a pair whose words
all come before `HELD_WORDS` share a group, so its blocks travel once and both passes are made over them there;
with an encoder (`encoded_links`) they don't travel at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrade.operators import align
from lexigrade.session import materialise

BLOCK_WORDS = 1024
#: Pairs whose words all have lower indices are held by one task, block by block.
HELD_WORDS = 4096

TILE = ["pair_id", "kaz_block", "rus_block"]
LINKS = "kz_idx int, ru_idx int, p_ru_given_kz double, p_kz_given_ru double"


def blocks_of(pooled: DataFrame, size: int = BLOCK_WORDS) -> DataFrame:
    """(pair_id, side, word_idx, vec) → (pair_id, side, block, word_idx list, flat vec list), `size` words at most; vectors are of one length."""
    word = F.struct("word_idx", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    grouped = pooled.groupBy("pair_id", "side", F.expr(f"cast(word_idx div {size} as int)").alias("block")).agg(
        F.sort_array(F.collect_list(word)).alias("w")
    )
    return grouped.select("pair_id", "side", "block", F.col("w.word_idx").alias("word_idx"), F.flatten("w.vec").alias("vec"))


def encoded_blocks(words_df: DataFrame, load, size: int = BLOCK_WORDS) -> DataFrame:
    """Blocks straight from an encoder of `align.encode_with`; no row holds more than a block's vectors.

    `words_df` has pair_id, kaz_words, rus_words. Pieces without a vector are left out; a word without
    any has no place in a block.
    """
    kind = dict(words_df.dtypes)["pair_id"]
    schema = f"pair_id {kind}, side string, block int, word_idx array<int>, vec array<double>"
    names = ["pair_id", "side", "block", "word_idx", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                for side in ("kaz", "rus"):
                    for b, keep, pooled in _row_blocks(encode(one.column(f"{side}_words")), size)[0]:
                        values = [one.column("pair_id"), pa.array([side]), pa.array([b], pa.int32())]
                        values += [pa.array([keep], pa.list_(pa.int32())), pa.array([pooled.ravel()], pa.list_(pa.float64()))]
                        yield pa.RecordBatch.from_arrays(values, names=names)

    return words_df.select("pair_id", "kaz_words", "rus_words").mapInArrow(run, schema)


def _row_blocks(encoded: tuple[pa.Array, pa.Array, pa.Array], size: int) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each row of an encoder's answer its blocks (block, word indices, vectors), in order."""
    counts, words, vectors = encoded
    good = vectors.is_valid().to_numpy(zero_copy_only=False)
    words = words.to_numpy(zero_copy_only=False)[good]
    flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.append(0, np.cumsum(good))[np.append(0, np.cumsum(counts.to_numpy(zero_copy_only=False)))]
    flat = flat.reshape(ends[-1], -1) if ends[-1] else flat
    rows = []
    for a, b in zip(ends, ends[1:]):
        blocks = []
        if a < b:
            keep, pooled = align.word_vectors(words[a:b], flat[a:b])
            for number in np.unique(keep // size):
                at = keep // size == number
                blocks.append((int(number), keep[at], pooled[at]))
        rows.append(blocks)
    return rows


def dealt(blocks: DataFrame, side: str) -> DataFrame:
    """The side's blocks, once for every block of the other side of their pair.

    Dealt by block before they are multiplied, as the join brings all of a pair together.
    """
    other = {"kaz": "rus", "rus": "kaz"}[side]
    numbers = blocks.where(F.col("side") == other).groupBy("pair_id").agg(F.collect_set("block").alias("_others"))
    own = blocks.where(F.col("side") == side).drop("side").withColumnRenamed("block", f"{side}_block")
    met = own.join(numbers, "pair_id").repartition("pair_id", f"{side}_block")
    tiles = met.withColumn(f"{other}_block", F.explode("_others")).drop("_others")
    return tiles.select(*(F.col(c).alias(c) for c in tiles.columns))  # columns of its own, told from the other side's


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    words = table.column("word_idx").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return words, table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(words), -1)


def _list(values: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def word_totals(blocks: DataFrame) -> DataFrame:
    """For every block its words' highest similarity and the sum of exponentials below it, over the whole other side."""
    kind = dict(blocks.dtypes)["pair_id"]
    schema = f"pair_id {kind}, side string, block int, high array<double>, total array<double>"
    names = ["pair_id", "side", "block", "high", "total"]

    def parts(kaz: pa.Table, rus: pa.Table) -> pa.Table:
        tables = []
        if kaz.num_rows and rus.num_rows:
            scores = _matrix(kaz)[1] @ _matrix(rus)[1].T
            for side, table, axis in (("kaz", kaz, 1), ("rus", rus, 0)):
                high = scores.max(axis=axis)
                total = np.exp(scores - np.expand_dims(high, axis)).sum(axis=axis)
                columns = [table.column("pair_id").combine_chunks(), pa.array([side]), table.column(f"{side}_block").combine_chunks()]
                tables.append(pa.Table.from_arrays([*columns, _list(high), _list(total)], names=names))
        empty = pa.schema([kaz.schema.field("pair_id"), ("side", pa.string()), ("block", pa.int32()),
                           ("high", pa.list_(pa.float64())), ("total", pa.list_(pa.float64()))])
        return pa.concat_tables(tables) if tables else empty.empty_table()

    def merge(table: pa.Table) -> pa.Table:
        high = np.stack(table.column("high").to_numpy())
        top = high.max(axis=0)
        total = (np.stack(table.column("total").to_numpy()) * np.exp(high - top)).sum(axis=0)
        first = table.slice(0, 1)
        return pa.Table.from_arrays([*(first.column(c).combine_chunks() for c in names[:3]), _list(top), _list(total)], names=names)

    tiles = dealt(blocks, "kaz").groupBy(*TILE).cogroup(dealt(blocks, "rus").groupBy(*TILE)).applyInArrow(parts, schema)
    return tiles.groupBy("pair_id", "side", "block").applyInArrow(merge, schema)


def tiled_links(blocks: DataFrame, threshold: float = align.LINK_THRESHOLD) -> DataFrame:
    """Links (pair_id, kz_idx, ru_idx, p_ru_given_kz, p_kz_given_ru) of all pairs in `blocks`.

    A pair with an empty side has none; a pair_id stands for one pair. The blocks are written once; those of pairs
    beyond `HELD_WORDS` go through `dealt_links`.
    """
    blocks = materialise(blocks)
    last = F.get("word_idx", F.size("word_idx") - 1)
    long = materialise(blocks.where(last >= HELD_WORDS).select("pair_id").distinct())
    short = blocks.where(F.col("pair_id").isNotNull()).join(long, "pair_id", "left_anti")
    found = held_links(short, threshold)
    if long.isEmpty():
        return found
    return found.unionByName(dealt_links(blocks.join(long, "pair_id", "left_semi"), threshold))


def encoded_links(words_df: DataFrame, load, size: int = BLOCK_WORDS, threshold: float = align.LINK_THRESHOLD) -> DataFrame:
    """`tiled_links(encoded_blocks(words_df, load, size), threshold)` in which only blocks of long pairs leave their tasks.

    A pair of up to `HELD_WORDS` words a side is encoded, cut into blocks and gone through tile by tile where its
    words are: no vector is written or shuffled. Longer ones, and rows that share a pair_id, go through
    `tiled_links`. A row without a pair_id has no links.
    """
    words = words_df.select("pair_id", "kaz_words", "rus_words").where(F.col("pair_id").isNotNull())
    longest = F.greatest(F.size("kaz_words"), F.size("rus_words"))
    counted = words.groupBy("pair_id").agg(F.max(longest).alias("_longest"), F.count(F.lit(1)).alias("_rows"))
    aside = materialise(counted.where((F.col("_longest") > HELD_WORDS) | (F.col("_rows") > 1)).select("pair_id"))
    kind = dict(words.dtypes)["pair_id"]
    names = ["pair_id", *(c.split()[0] for c in LINKS.split(", "))]
    kinds, at_once = [pa.int32(), pa.int32(), pa.float64(), pa.float64()], align.BATCH_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for batch in (part for whole in batches for part in align.sliced(whole, ["kaz_words", "rus_words"], at_once)):
            kaz, rus = (_row_blocks(encode(batch.column(f"{side}_words")), size) for side in ("kaz", "rus"))
            found = [_held(*([block[1:] for block in part] for part in pair), threshold) for pair in zip(kaz, rus)]
            if found:
                at = np.repeat(np.arange(len(found)), [len(links[0]) for links in found])
                columns = [pa.array(np.concatenate(part), kind) for part, kind in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("pair_id").take(pa.array(at)), *columns], names=names)

    none = aside.isEmpty()
    own = words if none else words.join(aside, "pair_id", "left_anti")
    found = own.mapInArrow(run, f"pair_id {kind}, {LINKS}")
    if none:
        return found
    return found.unionByName(tiled_links(encoded_blocks(words.join(aside, "pair_id", "left_semi"), load, size), threshold))


def _held(kaz: list[tuple[np.ndarray, np.ndarray]], rus: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[np.ndarray]:
    """The four columns of `LINKS` of one pair from its blocks (word indices, vectors), tile by tile."""
    highs, totals = ([[fill(len(words)) for words, _ in part] for part in (kaz, rus)]
                     for fill in (lambda n: np.full(n, -np.inf), np.zeros))
    for a, (_, k_vectors) in enumerate(kaz):
        for b, (_, r_vectors) in enumerate(rus):
            scores = k_vectors @ r_vectors.T
            for which, at, axis in ((0, a, 1), (1, b, 0)):
                before = highs[which][at]
                top = np.maximum(before, scores.max(axis=axis))
                sums = np.exp(scores - np.expand_dims(top, axis)).sum(axis=axis)
                totals[which][at] = totals[which][at] * np.exp(before - top) + sums
                highs[which][at] = top
    found = [[np.empty(0)] * 4]
    for a, (k_words, k_vectors) in enumerate(kaz):
        for b, (r_words, r_vectors) in enumerate(rus):
            scores = k_vectors @ r_vectors.T
            p_ru = np.exp(scores - highs[0][a][:, None]) / totals[0][a][:, None]
            p_kz = np.exp(scores - highs[1][b]) / totals[1][b]
            k, r = np.nonzero((p_ru > threshold) & (p_kz > threshold))
            found.append([k_words[k], r_words[r], p_ru[k, r], p_kz[k, r]])
    return [np.concatenate(part) for part in zip(*found)]


def held_links(blocks: DataFrame, threshold: float = align.LINK_THRESHOLD) -> DataFrame:
    """Links as from `dealt_links`, a pair in one group: tile by tile, first the totals, then the links."""
    kind = dict(blocks.dtypes)["pair_id"]
    names = ["pair_id", *(c.split()[0] for c in LINKS.split(", "))]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64()]

    def links(table: pa.Table) -> pa.Table:
        side, number = (table.column(c).to_pylist() for c in ("side", "block"))
        order = sorted(range(table.num_rows), key=lambda i: number[i])
        kaz, rus = ([_matrix(table.slice(i, 1)) for i in order if side[i] == s] for s in ("kaz", "rus"))
        if len({*zip(side, number)}) < table.num_rows:
            raise ValueError("a pair_id must stand for one pair")
        found = _held(kaz, rus, threshold)
        ids = table.column("pair_id").combine_chunks().take(pa.array(np.zeros(len(found[0]), np.int64)))
        return pa.Table.from_arrays([ids, *(pa.array(v, t) for v, t in zip(found, kinds))], names=names)

    return blocks.groupBy("pair_id").applyInArrow(links, f"pair_id {kind}, {LINKS}")


def dealt_links(blocks: DataFrame, threshold: float = align.LINK_THRESHOLD) -> DataFrame:
    """Links of pairs of any length, a tile in a group; the blocks with their totals are written, as both passes read them."""
    full = materialise(blocks.join(word_totals(blocks), ["pair_id", "side", "block"]))
    kind = dict(blocks.dtypes)["pair_id"]
    names = ["pair_id", *(c.split()[0] for c in LINKS.split(", "))]

    def links(kaz: pa.Table, rus: pa.Table) -> pa.Table:
        if not (kaz.num_rows and rus.num_rows):
            found = [np.empty(0)] * 4
        else:
            (k_words, k_vectors), (r_words, r_vectors) = _matrix(kaz), _matrix(rus)
            scores = k_vectors @ r_vectors.T
            at = {c: (kaz if c[0] == "k" else rus).column(c[2:]).combine_chunks().flatten().to_numpy() for c in ("k_high", "k_total", "r_high", "r_total")}
            p_ru = np.exp(scores - at["k_high"][:, None]) / at["k_total"][:, None]
            p_kz = np.exp(scores - at["r_high"]) / at["r_total"]
            k, r = np.nonzero((p_ru > threshold) & (p_kz > threshold))
            found = [k_words[k], r_words[r], p_ru[k, r], p_kz[k, r]]
        field = kaz.schema.field("pair_id")
        ids = kaz.column("pair_id").combine_chunks() if kaz.num_rows else pa.array([], field.type)
        pair = ids.take(pa.array(np.zeros(len(found[0]), np.int64)))
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pair, *(pa.array(v, t) for v, t in zip(found, kinds))], names=names)

    return dealt(full, "kaz").groupBy(*TILE).cogroup(dealt(full, "rus").groupBy(*TILE)).applyInArrow(links, f"pair_id {kind}, {LINKS}")
