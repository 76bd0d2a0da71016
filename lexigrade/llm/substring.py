"""Substring deduplication over content-defined chunks cut by a gear rolling hash.

Words end a chunk where the gear hash of the 16 bytes before says so, whatever stands further
away, so an insertion moves no cut beyond its own neighbourhood. Where a stretch has no space
(Chinese, Japanese, Thai, minified code), characters end chunks by the same hash. Chunks are compared by
the digest of as many adjoining ones as hold a passage's words, so what recurs stood together; a passage
stays where it comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrade.llm.common import bounded, cut, mix64, utf8

#: Of 64 places where a word ends, so many end a chunk: one in five words.
CUT_OF_64 = 13
#: Bytes without a space from which on characters may end a chunk too, so that few spaced words are
#: cut, and of 64 places so many do: a cut in about 32 bytes, of ASCII and of three-byte characters.
STRETCH = 32
CUT_OF_64_ASCII, CUT_OF_64_WIDE = 2, 6
#: Beyond that, so many bytes without a space count as another word.
WORD_BYTES = 12
#: Bytes without any cut after which one is forced, at the next character.
LONGEST = 4096
#: Adjoining chunks with so many words that recur together are a passage. A passage shared by two texts
#: loses the words before its first and after its last cut, ten to twenty in all.
MIN_WORDS = 18

#: Odd, so that it has an inverse.
BASE = 0x9E3779B97F4A7C15

GEAR = (mix64(np.arange(256, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def cuts(raw: np.ndarray, offsets: np.ndarray, cut_of_64: int = CUT_OF_64, longest: int = LONGEST) -> np.ndarray:
    """Ends of all chunks of the texts laid out in `raw`, every text's own end among them."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 bytes, each byte shifted by its distance
        moved = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += moved
    space = raw <= 0x20
    value = (h >> np.uint32(10)) & np.uint32(63)
    ends = np.flatnonzero(space & (value < cut_of_64)) + 1
    bare, _ = unspaced(space, offsets)
    if len(bare):
        bare = bare[value[bare] < np.where(raw[bare] < 0x80, CUT_OF_64_ASCII, CUT_OF_64_WIDE)] + 1
        ends = np.union1d(ends, bare[raw[np.minimum(bare, len(raw) - 1)] & 0xC0 != 0x80])
    # The hash must not look back into the text before: near a beginning there is no cut.
    begin = offsets[np.searchsorted(offsets, ends - 1, side="right") - 1]
    ends = np.union1d(ends[ends - begin >= 16], offsets[1:][np.diff(offsets) > 0])
    gaps = np.flatnonzero(np.diff(ends, prepend=0) > longest)
    if len(gaps):
        forced = []
        for g in gaps.tolist():
            last = int(ends[g])
            at = int(ends[g - 1]) if g else 0
            while last - at > longest:
                at += longest
                while at < last and raw[at] & 0xC0 == 0x80:
                    at += 1
                if at < last:
                    forced.append(at)
        ends = np.union1d(ends, np.array(forced, np.int64))
    return ends


def unspaced(space: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes with `STRETCH` bytes or more before them and no space, and how many those are."""
    edges = np.union1d(offsets, np.flatnonzero(space) + 1)
    start, length = edges[:-1], np.diff(edges)
    long = length > STRETCH
    start, length = start[long], length[long] - STRETCH
    before = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + STRETCH
    at = np.repeat(start, length) + before
    mine = ~space[at]
    return at[mine], before[mine]


@dataclass
class Windows:
    """The chunks of some texts, and the windows that begin at them: the adjoining chunks that first hold `min_words` words.

    The last window of a text comes twice, as far as its words reach and to the text's end (`closing`), so
    that windows cover a text whole.
    """

    begin: np.ndarray  # first byte of each chunk, in the bytes of all texts
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # chunks of each window
    last: np.ndarray
    closing: np.ndarray


def windows(raw: np.ndarray, offsets: np.ndarray, min_words: int) -> Windows:
    ends = cuts(raw, offsets)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    space = raw <= 0x20
    begins = ~space
    begins[1:] &= space[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = ~space[offsets[:-1][np.diff(offsets) > 0]]
    bare, before = unspaced(space, offsets)
    begins[bare[before % WORD_BYTES == 0]] = True
    total = np.concatenate([[0], np.cumsum(begins)])[np.append(starts, ends[-1])]
    reach = np.searchsorted(total, total[:-1] + min_words) - 1
    final = np.searchsorted(doc, doc, side="right") - 1
    first = np.flatnonzero(reach <= final)
    last = reach[first]
    # The last window of each text, where it leaves a rest.
    closes = np.append(doc[first][1:] != doc[first][:-1], True) if len(first) else np.zeros(0, bool)
    closes &= last < final[first]
    return Windows(
        starts, ends, doc, np.append(first, first[closes]), np.append(last, final[first[closes]]), np.append(np.zeros(len(first), bool), closes[closes])
    )


def window_rows(batch: pa.RecordBatch, min_words: int) -> pa.RecordBatch | None:
    """(row, place, digest) of each window: `place` packs where it begins in its text, whether it closes it, and a free bit.

    The digest is that of the window's chunk digests: a difference of sums in powers of an odd number.
    """
    raw, offsets = utf8(batch.column("text"))
    if not len(raw):
        return None
    w = windows(raw, offsets, min_words)
    if not len(w.first):
        return None
    data, digest = raw.tobytes(), xxhash.xxh3_64_intdigest
    single = np.fromiter((digest(data[a:b]) for a, b in zip(w.begin.tolist(), w.end.tolist())), np.uint64, len(w.end))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.append(np.uint64(1), np.full(len(single), BASE, np.uint64)))
        back = np.cumprod(np.append(np.uint64(1), np.full(len(single), pow(BASE, -1, 1 << 64), np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(single * powers[:-1]))
        digests = mix64((sums[w.last + 1] - sums[w.first]) * back[w.first] + mix64((w.last - w.first).astype(np.uint64)))
    place = (w.begin[w.first] - offsets[w.doc[w.first]]) << 2 | w.closing.astype(np.int64) << 1
    return pa.RecordBatch.from_arrays(
        [batch.column("row").take(pa.array(w.doc[w.first])), pa.array(place), pa.array(digests.view(np.int64))], names=["row", "place", "digest"]
    )


def passage_digests(docs: DataFrame, min_words: int) -> DataFrame:
    """Windows of `docs` (row, text); the last bit of `place` is free."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            found = window_rows(batch, min_words)
            if found is not None:
                yield found

    return docs.mapInArrow(scan, "row long, place long, digest long")


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The spans that windows cover together, begins ascending."""
    if not len(begin):
        return []
    reach = np.maximum.accumulate(end)
    new = np.append(True, begin[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return list(zip(begin[at].tolist(), reach[np.append(at[1:], len(begin)) - 1].tolist()))


def earlier_spans(texts: pa.Array, found: pa.Array, min_words: int) -> Iterator[list[tuple[int, int]]]:
    """For each text the byte spans of its recurring windows that stand in an earlier row, by their places `found`."""
    raw, offsets = utf8(texts)
    w = windows(raw, offsets, min_words) if len(raw) else None
    for row in range(len(texts)):
        place = found[row].values.to_numpy() if found[row].is_valid else np.zeros(0, np.int64)
        place = np.sort(place[(place & 1) == 1])
        if not len(place):
            yield []
            continue
        begin = (place >> 2) + offsets[row]
        chunk = np.searchsorted(w.begin, begin)
        # Windows stand in the order of their first chunk, the closing ones behind all others.
        plain = len(w.closing) - int(w.closing.sum())
        at = np.searchsorted(w.first[:plain], chunk)
        last = np.where((place & 2) > 0, np.searchsorted(w.doc, row, side="right") - 1, w.last[np.minimum(at, plain - 1)])
        yield merged(begin - offsets[row], w.end[last] - offsets[row])


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of `docs` (doc_id, text) as doc_id, text, repeated, n_removed, spans.

    `text` is without the passages that come in a row before; `repeated` says that a passage of
    the row also stands in another; what only recurs inside one text is left alone.
    `n_removed` counts bytes and `spans` are their byte ranges (start, end) in UTF-8. Of equal
    texts with `min_words` words all but the first are emptied; shorter ones hold no passage and stay. Null counts as empty. Rows are numbered in input
    order by one scan and written with their numbers, as a second scan of `docs` may be dealt
    out otherwise. Other columns are not read.

    Two narrow shuffles carry the windows' digests (24 bytes for about 30 of text, before they are
    compressed) and one the texts, whose chunks are then found again. A digest that recurs in any number of rows is summed before it moves
    and joined back by a join that Spark can split.
    """
    rows = cut(
        docs.select(
            F.monotonically_increasing_id().alias("row"), docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text")
        ),
        "zstd",
    )
    found = cut(passage_digests(rows.select("row", "text"), min_words), "zstd")
    counted = found.groupBy("digest").agg(F.min("row").alias("owner"), F.max("row").alias("last"))
    recurring = cut(counted.where("last > owner").select("digest", "owner"))
    earlier = (F.col("row") != F.col("owner")).cast("long")
    marked = found.join(recurring, "digest").select("row", F.col("place").bitwiseOR(earlier).alias("place"))
    by_row = marked.groupBy("row").agg(F.collect_list("place").alias("found"))
    joined = rows.join(by_row, "row", "left").select("doc_id", "text", "found")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 1 << 20):
            texts, gone, where = [], [], []
            marks = batch.column("found")
            flags = marks.is_valid().to_pylist()
            for text, spans in zip(batch.column("text").to_pylist(), earlier_spans(batch.column("text"), marks, min_words)):
                if spans:
                    data, at, left = text.encode(), 0, []
                    for start, end in spans:
                        left.append(data[at:start])
                        at = end
                    text = b"".join([*left, data[at:]]).decode()
                texts.append(text)
                gone.append(sum(b - a for a, b in spans))
                where.append([{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(texts, pa.string()),
                    pa.array(flags, pa.bool_()),
                    pa.array(gone, pa.int64()),
                    pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "text", "repeated", "n_removed", "spans"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(
        remove, f"doc_id {kind}, text string, repeated boolean, n_removed long, spans array<struct<start:int,end:int>>"
    )
