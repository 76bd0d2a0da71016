"""Sub-word pieces of words by greedy longest match, and vectors computed from them.

The vocabulary is that of a public tokenizer; none is trained here. It is loaded once per task
from a file that every node has, as a trie whose nodes are the prefixes of its pieces. A worker remembers
the pieces of words it has seen.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The id of a word that the vocabulary can't spell; it has no vector.
UNKNOWN_PIECE = -1
REMEMBERED_WORDS, REMEMBERED_BYTES = 200_000, 64
#: Weights of the piece before, of the piece itself and of the one behind it.
MIX = (0.25, 0.5, 0.25)
MAX_TABLE_BYTES = 256 << 20

PIECE_IDS = "array<struct<word_idx:int,piece_idx:int,piece_id:int>>"
Vocabulary = Callable[[], dict[bytes, int]]


def ranks_file(path: str) -> Vocabulary:
    """A vocabulary of byte strings from a file of lines `base64 id`."""

    def load() -> dict[bytes, int]:
        with open(path, "rb") as lines:
            return {base64.b64decode(piece): int(number) for piece, number in map(bytes.split, lines)}

    return load


class Splitter:
    """Cuts a word into the longest pieces of the vocabulary, from left to right.

    `before` is what stands in front of a word where the vocabulary was made, a space say. A word with
    a place where no piece fits is one unknown piece.
    """

    def __init__(self, vocabulary: dict[bytes, int], before: bytes = b" ") -> None:
        self.trie: dict[bytes, int] = {}
        for piece, number in vocabulary.items():
            for end in range(1, len(piece)):
                self.trie.setdefault(piece[:end], UNKNOWN_PIECE)
            if piece:
                self.trie[piece] = number
        self.before = before
        self.known: dict[str, tuple[int, ...]] = {}

    def _match(self, word: bytes) -> tuple[int, ...]:
        out, at, get = [], 0, self.trie.get
        while at < len(word):
            best, end = UNKNOWN_PIECE, at + 1
            place = end
            while (found := get(word[at:end])) is not None:
                if found != UNKNOWN_PIECE:
                    best, place = found, end
                if end == len(word):
                    break
                end += 1
            if best == UNKNOWN_PIECE:
                return (UNKNOWN_PIECE,)
            out.append(best)
            at = place
        return tuple(out)

    def split(self, word: str) -> tuple[int, ...]:
        pieces = self.known.get(word)
        if pieces is None:
            raw = word.encode()
            pieces = self._match(self.before + raw)
            if len(raw) <= REMEMBERED_BYTES:
                if len(self.known) >= REMEMBERED_WORDS:
                    self.known.clear()
                self.known[word] = pieces
        return pieces

    def split_lists(self, lists: pa.Array, limit: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each list of words its number of pieces, then all pieces' word indices and ids.

        A list keeps its first `limit` pieces, as an encoder with a limit does.
        """
        counts, words, ids = [], [], []
        for row in lists.to_pylist():
            room = limit
            before = len(ids)
            for index, word in enumerate(row or ()):
                pieces = self.split(word)
                if room is not None:
                    pieces = pieces[:room]
                    room -= len(pieces)
                ids.extend(pieces)
                words.extend([index] * len(pieces))
                if room == 0:
                    break
            counts.append(len(ids) - before)
        return np.array(counts, np.int64), np.array(words, np.int64), np.array(ids, np.int64)


def places(counts: np.ndarray) -> np.ndarray:
    """The place of every piece within its list."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def with_piece_ids(words_df: DataFrame, vocabulary: Vocabulary, max_pieces: int | None = None, before: bytes = b" ") -> DataFrame:
    """Add `kaz_ids` and `rus_ids`, the pieces of `kaz_words` and `rus_words`, and `truncated`.

    `truncated` tells that the limit of pieces left a side's last word without any. Null or empty lists have no
    pieces. No row is shuffled.
    """
    added = [T.StructField(f"{side}_ids", T.ArrayType.fromDDL(PIECE_IDS)) for side in ("kaz", "rus")]
    schema = T.StructType([*words_df.schema.fields, *added, T.StructField("truncated", T.BooleanType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(vocabulary(), before)
        for batch in batches:
            columns, cut = [], np.zeros(batch.num_rows, bool)
            for side in ("kaz", "rus"):
                lists = batch.column(f"{side}_words")
                counts, words, ids = splitter.split_lists(lists, max_pieces)
                ends = np.append(0, np.cumsum(counts))
                piece = pa.StructArray.from_arrays(
                    [pa.array(x, pa.int32()) for x in (words, places(counts), ids)], names=["word_idx", "piece_idx", "piece_id"]
                )
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), piece))
                last = np.full(batch.num_rows, -1)
                last[counts > 0] = words[ends[1:][counts > 0] - 1]
                cut |= last < lists.value_lengths().fill_null(0).to_numpy() - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(cut)], names=names)

    return words_df.mapInArrow(run, schema)


def hold_vectors(table: DataFrame, max_bytes: int = MAX_TABLE_BYTES) -> Broadcast:
    """The vectors (piece_id, vec) of a vocabulary's pieces for the tasks: a matrix with a row for each id.

    Their number is that of the vocabulary's pieces, whatever the corpus; it is measured first, and
    a table beyond `max_bytes` is refused.
    """
    spark = table.sparkSession
    kept = table.where("piece_id >= 0 AND vec IS NOT NULL")
    top, width = kept.agg(F.max("piece_id"), F.max(F.size("vec"))).first()
    shape = (int(top or 0) + 1, int(width or 0))
    if shape[0] * shape[1] * 4 > max_bytes:
        raise ValueError(f"a matrix of {shape[0]} by {shape[1]} floats is beyond {max_bytes} bytes")
    matrix = np.full(shape, np.nan, np.float32)
    for row in kept.toLocalIterator():
        if len(row["vec"]) == shape[1]:
            matrix[row["piece_id"]] = row["vec"]
    return spark.sparkContext.broadcast(matrix)


def mixed(vectors: np.ndarray, known: np.ndarray, place: np.ndarray, mix: tuple[float, float, float]) -> np.ndarray:
    """Each piece's vector with its neighbours' in the text, by the weights of those that are there."""
    before, own, behind = mix
    base = np.where(known[:, None], vectors, 0.0)
    total, weight = own * base, own * known
    link = place[1:] > 0  # a piece and the one before it are of one text
    total[1:] += before * base[:-1] * link[:, None]
    weight[1:] += before * known[:-1] * link
    total[:-1] += behind * base[1:] * link[:, None]
    weight[:-1] += behind * known[1:] * link
    return total / np.where(weight > 0, weight, 1.0)[:, None]


def piece_encoder(vocabulary: Vocabulary, held: Broadcast, max_pieces: int | None = None, mix: tuple = MIX, before: bytes = b" "):
    """An encoder for `align.encode_with`: piece vectors, each mixed with its neighbours', no shuffle.

    A piece without a vector of its own (unknown, or not in the table) gets none.
    """

    def load():
        splitter, matrix = Splitter(vocabulary(), before), held.value

        def encode(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
            counts, words, ids = splitter.split_lists(lists, max_pieces)
            found = matrix[np.where((ids >= 0) & (ids < len(matrix)), ids, 0)].astype(np.float64)
            known = (ids >= 0) & (ids < len(matrix)) & ~np.isnan(found).any(axis=1)
            vectors = mixed(found, known, places(counts), mix).astype(np.float32)
            width = matrix.shape[1]
            offsets = pa.array(np.arange(len(ids) + 1) * width, pa.int32())
            lists_of = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()), mask=pa.array(~known))
            return pa.array(counts), pa.array(words), lists_of

        return encode

    return load
