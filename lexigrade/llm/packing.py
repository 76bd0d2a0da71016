"""Lexical retrieval packing: windows of tokens filled with a document and its BM25 neighbours.

Every document is cut into full windows and a tail. Tails are dealt to shards of bounded
size, those that share their first terms to the same; a shard is an inverted index. The longest unused tail
is a seed, the index returns its unused neighbours, and they fill the seed's window greedily;
what is left of the window takes the beginning of the best neighbour that doesn't fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrade.llm.common import bounded, cut, mix64
from lexigrade.llm.tokens import encoder

WINDOW = 2048
END = 1
#: Tokens in a shard, about: what one task indexes at once.
SHARD_TOKENS = 1 << 20
#: Terms of a tail by which its shard is found; a term that fills shards is parted by the next.
TERMS = 4
#: Prefixes of terms that fill shards are broadcast up to this number, and joined by shuffles beyond it.
HOT_ROWS = 1 << 20
#: Terms of a seed that are looked up, its heaviest, and the usual BM25 constants.
QUERY_TERMS = 32
K1, B = 1.2, 0.75

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_files() -> tuple[str, ...]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def term_order(size: int) -> np.ndarray:
    """Token ids, the one to be preferred as a shard's term first.

    Each token has an exponential waiting time by its hash, shorter for higher ids: byte-pair
    ids rise as merges grow rarer. Two tails have the same first term the likelier, the larger the
    share of such tokens that they have in common.
    """
    ids = np.arange(size, dtype=np.uint64)
    uniform = ((mix64(ids) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return np.argsort(-np.log(uniform) / (ids.astype(np.float64) + 1) ** 2, kind="stable")


def cut_documents(docs: DataFrame, files: tuple[str, ...], window: int) -> DataFrame:
    """Full windows, which are sequences of their own, tails with their ids (little-endian) and first `terms`, and counts.

    `number` counts a task's pieces, with the task in front. A task's last rows say in how many (`n`) of its
    tails each `token` occurs; token -1 stands for its tails and -2 for their length.
    """
    schema = f"{PIECE}, number long, terms array<int>, ids binary, token int, n long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(*files), np.array([END])
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "number", "terms", "ids", "token", "n"]
        kinds = [pa.int64()] * 8 + [pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.int64()]
        order = term_order(coder.tokenizer.get_vocab_size())
        place = np.empty(len(order), coder.kind)
        place[order] = np.arange(len(order))
        counts, tails, length = np.zeros(len(order), np.int64), 0, 0
        number = TaskContext.get().partitionId() << 40
        for batch in bounded(batches, "text"):
            rows = []
            texts = batch.column("text").fill_null("").to_pylist()
            for doc, found in zip(batch.column("doc_id").to_pylist(), coder.encode(texts)):
                ids = np.append(found, end.astype(found.dtype))
                total = len(ids)
                for start in range(0, total, window):
                    piece = ids[start : start + window]
                    number += 1
                    if len(piece) == window:
                        rows.append((doc, start, window, crc(piece), total, number << 1, 0, number, None, None, None, None))
                    else:
                        places = np.unique(place[piece])
                        counts[places] += 1
                        tails, length = tails + 1, length + len(piece)
                        terms = order[places[:TERMS]].tolist()
                        rows.append((doc, start, len(piece), None, total, None, None, number, terms, piece.tobytes(), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)], names=names)
        at = np.flatnonzero(counts)
        token, n = [*order[at].tolist(), -1, -2], [*counts[at].tolist(), tails, length]
        empty = [pa.nulls(len(token), kind) for kind in kinds[:-2]]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(token, kinds[-2]), pa.array(n, kinds[-1])], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(scan, schema)


def term_frequency(pieces: DataFrame) -> tuple[np.ndarray, float]:
    """Each token's weight by the number of all tails it occurs in, and the mean length of a tail; a row per token of the vocabulary."""
    counts = pieces.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(counts["token"], counts["n"]))
    rows, length = int(found.pop(-1, 0)), int(found.pop(-2, 0))
    frequency = np.zeros(int(max(found, default=0)) + 1)
    frequency[list(found)] = list(found.values())
    return np.log(1 + (rows - frequency + 0.5) / (frequency + 0.5)), length / max(rows, 1)


def with_shards(tails: DataFrame, shard_tokens: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`tails` (number, length, terms and others) with `shard`, a hash.

    The first terms of a tail are a path in a tree. A node with more than `shard_tokens` tokens is
    parted by the next term; its children that are no larger share its shards by their hash. Only below the
    last term, where tails agree in all of them, are tails dealt by their number. Nodes that fill shards
    are as many as the shards at each depth: `hot_rows` of them are broadcast, and more are joined with bare numbers.
    """
    levels = range(1, TERMS + 1)
    keys = {"key0": F.lit(0).cast("long"), **{f"key{j}": F.xxhash64(F.lit(j), F.slice("terms", 1, j)) for j in levels}}
    tails = tails.withColumns(keys)
    nodes = [F.struct(F.col(f"key{j}").alias("key"), (F.col(f"key{j - 1}") if j else F.lit(None).cast("long")).alias("parent")) for j in (0, *levels)]
    sizes = tails.select("length", F.inline(F.array(*nodes))).groupBy("key", "parent").agg(F.sum("length").alias("tokens"))
    hot = cut(sizes.where((F.col("tokens") > shard_tokens) | F.col("parent").isNull()))
    inside = hot.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.sum("tokens").alias("inside"))
    rest = F.col("tokens") - F.coalesce("inside", F.lit(0))
    shards = lambda tokens: F.greatest(F.ceil(tokens / shard_tokens), F.lit(1)).cast("long")
    hot = cut(hot.join(inside, "key", "left").select("key", "parent", shards(F.col("tokens")).alias("own"), shards(rest).alias("shared")))
    root = hot.where("parent is null").first()
    nodes = hot.where("parent is not null").select("key", "own", "shared")
    few = nodes.count() <= hot_rows

    rows = tails if few else tails.select("number", *keys)
    rows = rows.withColumn("shared0", F.lit(root["shared"] if root else 1))
    for j in levels:
        node = nodes.toDF(f"key{j}", f"own{j}", f"shared{j}")
        rows = rows.join(F.broadcast(node) if few else node, f"key{j}", "left")
    last = f"key{TERMS}"
    shard = F.xxhash64(last, F.lit("number"), F.pmod(F.xxhash64("number"), f"own{TERMS}"))
    for j in reversed(levels):
        child = F.xxhash64(f"key{j - 1}", F.lit("child"), F.pmod(f"key{j}", f"shared{j - 1}"))
        shard = F.when(F.col(f"own{j}").isNull(), child).otherwise(shard)
    rows = rows.withColumn("shard", shard)
    rows = rows if few else tails.join(rows.select("number", "shard"), "number")
    return rows.drop("terms", *keys, "shared0", *(f"{name}{j}" for name in ("own", "shared") for j in levels))


class Index:
    """Inverted BM25 index of one shard over token ids."""

    def __init__(self, pieces: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        lengths = np.array([len(p) for p in pieces])
        doc = np.repeat(np.arange(len(pieces)), lengths)
        key, tf = np.unique(np.concatenate(pieces).astype(np.int64) * len(pieces) + doc, return_counts=True)
        token, self.docs = np.divmod(key, len(pieces))
        norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        self.weights = (idf[token] * tf * (K1 + 1) / (tf + norm[self.docs])).astype(np.float32)
        self.tokens, first = np.unique(token, return_index=True)
        self.first = np.append(first, len(token))
        # The heaviest terms of each tail, as places in `tokens`.
        place = np.repeat(np.arange(len(self.tokens)), np.diff(self.first))
        order = np.lexsort((place, -self.weights, self.docs))
        starts = np.searchsorted(self.docs[order], np.arange(len(pieces) + 1))
        self.heavy = [place[order[a : min(b, a + QUERY_TERMS)]] for a, b in zip(starts[:-1], starts[1:])]
        self.score = np.zeros(len(pieces), np.float32)

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused tails that share a term with the seed's heaviest, best first."""
        score = self.score
        score[:] = 0
        for t in self.heavy[seed]:
            a, b = self.first[t], self.first[t + 1]
            score[self.docs[a:b]] += self.weights[a:b]
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill(pieces: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (tail, start within it, length); every token of every tail lies in exactly one.

    All windows but the last are full.
    """
    index = Index(pieces, idf, mean)
    lengths = np.array([len(p) for p in pieces])
    start = np.zeros(len(pieces), np.int64)
    unused = np.ones(len(pieces), bool)
    by_length = np.argsort(-lengths, kind="stable")
    at = 0
    while unused.any():
        while not unused[by_length[at]]:
            at += 1
        seed = int(by_length[at])
        unused[seed] = False
        out, room = [(seed, int(start[seed]), int(lengths[seed] - start[seed]))], window - int(lengths[seed] - start[seed])
        too_long = -1
        near = index.neighbours(seed, unused)
        for tails in (near, by_length[at:] if room else []):
            for d in tails:
                if not room:
                    break
                if not unused[d]:
                    continue
                left = int(lengths[d] - start[d])
                if left <= room:
                    out.append((int(d), int(start[d]), left))
                    unused[d] = False
                    room -= left
                elif too_long < 0:
                    too_long = int(d)
            if room and too_long >= 0:
                out.append((too_long, int(start[too_long]), room))
                start[too_long] += room
                room = 0
            if not room:
                break
        yield out


def pack(docs: DataFrame, files: tuple[str, ...] | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all `docs` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer and a closing 1; null counts as empty, an
    empty text is the closing id alone. Sequences hold `window` tokens but for the last of a
    shard. Frequencies are counted over all tails. Texts are tokenized once and the ids
    written; the tails' ids are shuffled once. Repeated rows and ids are separate documents;
    other columns are not read. An empty table gives no rows.
    """
    files = files or default_files()
    pieces = cut(cut_documents(docs, files, window))
    tails = pieces.where("ids is not null").select("doc_id", "start", "length", "doc_tokens", "number", "terms", "ids")
    kind = encoder(*files).kind.str
    idf, mean = term_frequency(pieces)
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("number").combine_chunks()
        doc, first, total, number = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "number"))
        ids = [np.frombuffer(raw, kind) for raw in table.column("ids").to_pylist()]
        rows = []
        for placed in fill(ids, held.value, mean, window):
            sequence, offset = (number[placed[0][0]] << 1) + 1, 0  # a tail is the seed of one window at most
            for d, start, length in placed:
                rows.append((doc[d], first[d] + start, length, crc(ids[d][start : start + length]), total[d], sequence, offset))
                offset += length
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.Table.from_arrays([pa.array(values, pa.int64()) for values in zip(*rows)], names=names)

    packed = with_shards(tails, shard_tokens).groupBy("shard").applyInArrow(shard, PIECE)
    return pieces.where("sequence_id is not null").select(packed.columns).unionByName(packed)
