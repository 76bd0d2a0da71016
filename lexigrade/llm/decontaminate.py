"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. All patterns of one length are searched
together: a table over blocks of two words says how far the window may jump, a block that
ends a pattern leads to its bucket, and the words of the window decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrade.llm.common import bounded, cut, texts

WINDOW = 10
#: Benchmark words held by a task at once; more are searched in further passes.
PASS_WORDS = 1_000_000
#: Words of an item that one pass takes as a piece; pieces overlap so that no window is lost.
PIECE_WORDS = 4_096
#: Bytes of documents that a task searches under one pass before it loads the next.
GATHERED = 64 << 20

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of lower-cased letters a-z, digits and everything beyond ASCII."""
    return text.translate(_FOLD).split()


class Searcher:
    """Wu-Manber tables of one pass: `items` are (item number, words), each cut in windows of `window` words."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, item_words in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in item_words]
            length = min(window, len(ids))
            if length:
                patterns = by_length.setdefault(length, {})
                for i in range(len(ids) - length + 1):
                    patterns.setdefault(tuple(ids[i : i + length]), set()).add(item)
        self.base = len(self.number) + 1
        self.lengths = [(n, patterns, *self._tables(n, patterns)) for n, patterns in sorted(by_length.items())]

    def _tables(self, length: int, patterns: dict[tuple[int, ...], set[int]]) -> tuple[dict[int, int], dict[int, list[tuple[int, ...]]]]:
        """How far to jump after each block, and the patterns that end with it."""
        shift: dict[int, int] = {}
        bucket: dict[int, list[tuple[int, ...]]] = {}
        for p in patterns:
            for j in range(1, length):
                block = p[j - 1] * self.base + p[j]
                shift[block] = min(shift.get(block, length), length - 1 - j)
            if length > 1:
                bucket.setdefault(p[-2] * self.base + p[-1], []).append(p)
        return shift, {k: sorted(v) for k, v in bucket.items()}

    def search(self, found_words: list[bytes]) -> list[tuple[int, int, set[int]]]:
        """(start, length, items) of every occurrence of a window."""
        get = self.number.get
        ids = [get(w, 0) for w in found_words]
        hits, base, n = [], self.base, len(ids)
        for length, patterns, shift, bucket in self.lengths:
            if length == 1:
                hits += [(i, 1, patterns[(w,)]) for i, w in enumerate(ids) if (w,) in patterns]
                continue
            i, far, jump = length - 1, length - 1, shift.get
            while i < n:
                block = ids[i - 1] * base + ids[i]
                step = jump(block, far)
                if step:
                    i += step
                    continue
                start = i - length + 1
                if len(bucket[block]) <= 8:
                    here = next((p for p in bucket[block] if p[0] == ids[start] and list(p) == ids[start : i + 1]), None)
                else:  # a crowded bucket is looked up by the whole window
                    here = tuple(ids[start : i + 1])
                if here in patterns:
                    hits.append((start, length, patterns[here]))
                i += 1
        return hits


def pieces(benchmark: DataFrame, window: int, piece_words: int) -> DataFrame:
    """The items' words in pieces that overlap by a window: item, words (joined by spaces), n, and where
    the piece stands: `part`, the task that cut it, and `before`, the words of the pieces before it there."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in bounded(batches, "text"):
            rows = []
            for item, text in zip(batch.column("item").to_pylist(), texts(batch.column("text"))):
                found = words(text)
                for start in range(0, max(len(found) - window + 1, 1) if found else 0, piece_words - window + 1):
                    piece = found[start : start + piece_words]
                    rows.append((item, b" ".join(piece), len(piece), part, before))
                    before += len(piece)
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "words", "n", "part", "before"])

    rows = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), benchmark["text"].alias("text"))
    return rows.mapInArrow(scan, "item string, words binary, n long, part int, before long")


def written_passes(benchmark: DataFrame, pass_words: int, window: int, piece_words: int) -> list[str]:
    """Cuts the items into passes of about `pass_words` words and writes each as a Parquet file that tasks
    find by the returned name.

    Tasks cut and number the pieces; the driver sees one word count per task. The files are
    registered with the application: an executor fetches them before its first task that follows,
    also one that takes the place of a lost one. A pass holds `pass_words` words at most as long as a
    piece has no more than half of them.
    """
    spark = benchmark.sparkSession
    found = cut(pieces(benchmark, window, piece_words))
    total, offsets = 0, []
    for part, n in sorted(map(tuple, found.groupBy("part").agg(F.sum("n")).collect())):
        offsets.append((part, total))
        total += n
    if not total:
        return []
    step = max(pass_words - piece_words, pass_words // 2, 1)
    placed = found.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part")
    number = F.floor((F.col("offset") + F.col("before")) / step).cast("int")
    files = cut(placed.repartitionById(-(-total // step), number).select("item", "words")).inputFiles()
    for file in files:
        spark.sparkContext.addFile(file)
    return sorted(file.rpartition("/")[2] for file in files)


_SEARCHERS: dict[tuple[str, int], tuple[list[str], Searcher]] = {}


def _searcher(name: str, window: int) -> tuple[list[str], Searcher]:
    """Tables of the pass in file `name`, kept in the Python worker for its later tasks (two passes at most)."""
    key = name, window
    if key not in _SEARCHERS:
        if len(_SEARCHERS) > 1:
            _SEARCHERS.clear()
        held = pq.read_table(SparkFiles.get(name))
        items = held.column("item").to_pylist()
        ids = sorted(set(items))
        at = {item: i for i, item in enumerate(ids)}
        _SEARCHERS[key] = ids, Searcher([(at[item], w.split()) for item, w in zip(items, held.column("words").to_pylist())], window)
    return _SEARCHERS[key]


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches with about `limit` bytes, one batch at least."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    pass_words: int = PASS_WORDS,
    names: tuple[str, str, str] = ("n_words", "spans", "items"),
    piece_words: int = PIECE_WORDS,
) -> DataFrame:
    """`docs` (text and others) with n_words, spans (merged runs of hit words), items (sorted ids).

    No document is shuffled, and no item passes through the driver: a task loads one written pass
    of at most `pass_words` benchmark words after the other. Where there are more passes than one, it
    searches `GATHERED` bytes of documents under each before it takes the next documents.
    Null or wordless texts have no hit, null or wordless items no window; a null item id
    reads as the empty id, and items with equal ids are one item. Repeated rows are searched one by one,
    and a text of any length is searched whole, in a slice of its own. The `names` must be free.
    """
    n_words, spans, hit_items = names
    rows = docs.withColumns(
        {
            n_words: F.lit(0).cast("long"),
            spans: F.array().cast("array<int>"),
            hit_items: F.array().cast("array<string>"),
        }
    )
    passes = written_passes(benchmark, pass_words, window, piece_words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(bounded(batches, "text"), GATHERED if len(passes) > 1 else 0):
            count = [[] for _ in group]
            where = [[[] for _ in range(batch.num_rows)] for batch in group]
            hit = [[[] for _ in range(batch.num_rows)] for batch in group]
            for name in passes or [None]:
                ids, searcher = _searcher(name, window) if name else ([], Searcher([], window))
                for k, batch in enumerate(group):
                    count[k] = []
                    for at, text in enumerate(texts(batch.column("text"))):
                        found = words(text)
                        count[k].append(len(found))
                        hits = searcher.search(found)
                        if hits:
                            hit[k][at] = sorted({*hit[k][at], *(ids[i] for _, _, mine in hits for i in mine)})
                            before = where[k][at]
                            where[k][at] = merged([*zip(before[::2], before[1::2]), *((s, s + n) for s, n, _ in hits)])
            for k, batch in enumerate(group):
                new = {n_words: pa.array(count[k], pa.int64()), spans: pa.array(where[k], pa.list_(pa.int32())), hit_items: pa.array(hit[k], pa.list_(pa.string()))}
                columns = [new.get(name, column) for name, column in zip(batch.schema.names, batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(search, rows.schema)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Start, end, start, end ... of the union of the spans."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of `find`."""
    length = F.aggregate(
        F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return found.select(
        "doc_id",
        "n_words",
        length.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
