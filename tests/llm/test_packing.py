import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexigrade.llm import packing, tokens

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("files", [(JSON,), packing.default_files()])
def test_ids_equal_the_tokenizers(files):
    plain, rng = Tokenizer.from_file(JSON), random.Random(1)
    alphabet = [*"ab1'é.\n \t\r    日<|>, s", "<|endoftext|>", "'s", " ' ", "\x1c "]
    texts = ["", " ", "a", " a  b", *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    got = tokens.encoder(*files).encode(texts)
    assert [g.tolist() for g in got] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def check(spark, docs, pieces, window):
    """Every id of every document in exactly one piece, sequences gapless, little padding."""
    plain = Tokenizer.from_file(JSON)
    want = defaultdict(list)
    for r in docs:
        want[r["doc_id"]].append([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(want)
    for doc, found in by_doc.items():
        spans = sorted((p["start"], p["length"], p["ids_crc32"]) for p in found)
        copies = len(want[doc])
        assert sum(n for _, n, _ in spans) == sum(map(len, want[doc]))
        if copies == 1:
            at = 0
            for p, (start, length, crc) in zip(sorted(found, key=lambda p: p["start"]), spans):
                assert start == at and length > 0 and p["doc_tokens"] == len(want[doc][0])
                assert crc == zlib.crc32(np.array(want[doc][0][start : start + length], "<u4").tobytes())
                at += length
    padding = total = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        total += at
        padding += window - at
    return padding / max(total, 1)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs, shard_tokens=100_000).collect()
    assert check(spark, docs.collect(), pieces, 2048) < 0.03


def test_neighbours_share_words():
    rng = np.random.default_rng(5)
    topics = [rng.permutation(1000)[:40] + 1000 * k for k in range(4)]
    pieces = [rng.choice(topics[i % 4], 100).astype("<u2") for i in range(200)]
    found = list(packing.fill(pieces, np.ones(5000), 100.0, 1000))
    assert [sum(n for _, _, n in w) for w in found] == [1000] * 20
    pure = [len({d % 4 for d, _, _ in w}) == 1 for w in found]
    assert sum(pure) >= 16
    seen = sorted((d, s, n) for w in found for d, s, n in w)
    for d in range(200):
        at = 0
        for _, s, n in [x for x in seen if x[0] == d]:
            assert s == at
            at += n
        assert at == 100


def test_scores_are_bm25():
    pieces = [np.array(p, "<u2") for p in ([1, 1, 2], [1, 3], [2, 2, 2, 4], [5])]
    idf = np.array([0, 0.5, 1.0, 2.0, 3.0, 4.0])
    mean = 2.5
    got = packing.Index(pieces, idf, mean)

    def weight(t, d):
        tf = (pieces[d] == t).sum()
        return idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(pieces[d]) / mean))

    near = got.neighbours(0, np.array([False, True, True, True]))
    assert near.tolist() == sorted([1, 2], key=lambda d: -(weight(1, d) + weight(2, d)))
    assert got.score[1] == pytest.approx(weight(1, 1)) and got.score[2] == pytest.approx(weight(2, 2))
    assert got.neighbours(3, np.array([True, True, True, False])).tolist() == []


def test_odd_rows(spark):
    rows = [(1, None, 1), (None, "", 2), (2, "a b", 3), (2, "a b", 3), (3, "word " * 9000, 4), (5, "<|endoftext|>", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").selectExpr("*", "1 as ids", "2 as shard")
    for shard_tokens in (1 << 20, 64):
        pieces = packing.pack(docs, shard_tokens=shard_tokens).collect()
        check(spark, docs.collect(), pieces, 2048)
    assert packing.pack(docs.limit(0)).count() == 0


def test_names_of_the_operator_in_the_table(spark):
    rows = [(i, f"word{i} " * (i * 7)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    named = docs.selectExpr("*", "1 as number", "2 as term", "3 as tokens", "4 as own", "5 as start", "6 as sequence_id")
    want = sorted(map(tuple, packing.pack(docs).collect()))
    assert sorted(map(tuple, packing.pack(named).collect())) == want
    check(spark, named.collect(), packing.pack(named).collect(), 2048)


def shards_of(spark, tails, limit, **how):
    rows = [(i, 100, list(terms)) for i, terms in enumerate(tails)]
    placed = packing.with_shards(spark.createDataFrame(rows, "number long, length long, terms array<int>"), limit, **how)
    assert placed.columns == ["number", "length", "shard"]
    return {r["number"]: r["shard"] for r in placed.collect()}


def test_a_term_of_all_tails_is_parted_by_the_next(spark):
    """Every tail begins with the same term; the second has 40 values, two of which fill shards themselves."""
    second = lambda i: 1000 + (i % 4 if i % 4 < 2 else 2 + i % 38)
    tails = [(7, second(i), 2000 + i % 90, 3000 + i) for i in range(3000)]
    shard = shards_of(spark, tails, 20_000)
    sizes, met = defaultdict(int), defaultdict(set)
    for i, s in shard.items():
        sizes[s] += 100
        met[tails[i][:2]].add(s)
    assert len(shard) == len(tails) and max(sizes.values()) <= 60_000
    assert all((len(found) > 1) == (term[1] < 1002) for term, found in met.items())
    whole = defaultdict(set)
    for i, s in shard.items():
        whole[tails[i][:3]].add(s)
    assert all(len(found) == 1 for found in whole.values())
    assert shards_of(spark, tails, 20_000, hot_rows=0) == shard


def test_copies_and_short_tails_are_dealt_out(spark):
    """A third are copies and another third have one term only: no shard takes them all, and none is lost."""
    rng = random.Random(3)
    tails = [(1, 2, 3, 4)] * 1000 + [(5,)] * 1000 + [tuple(rng.sample(range(10, 5000), 4)) for _ in range(1000)]
    shard = shards_of(spark, tails, 10_000)
    sizes = defaultdict(int)
    for s in shard.values():
        sizes[s] += 100
    assert len(shard) == 3000 and max(sizes.values()) < 30_000
    assert {shard[i] for i in range(1000)}.isdisjoint(shard[i] for i in range(1000, 3000))
    assert shards_of(spark, tails, 10_000, hot_rows=0) == shard
    assert len(set(shards_of(spark, tails, 10**9).values())) == 1


def test_weights_are_counted_over_all_tails(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [r["text"] or "" for r in docs.collect()]
    idf, mean = packing.term_frequency(packing.cut_documents(docs.repartition(3), packing.default_files(), 512))
    plain, found, tails, length = Tokenizer.from_file(JSON), defaultdict(int), 0, 0
    for text in rows:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        tail = ids[len(ids) - len(ids) % 512 :]
        tails, length = tails + bool(tail), length + len(tail)
        for t in set(tail):
            found[t] += 1
    assert mean == pytest.approx(length / tails)
    assert {t: idf[t] for t in found} == pytest.approx({t: np.log(1 + (tails - n + 0.5) / (n + 0.5)) for t, n in found.items()})


def test_order_of_terms():
    order = packing.term_order(5000)
    assert sorted(order.tolist()) == list(range(5000))
    assert order[:100].mean() > order[-100:].mean()


def test_shards_need_no_nested_loop(spark):
    rows = spark.createDataFrame([(i, 100, [1, i]) for i in range(50)], "number long, length long, terms array<int>")
    placed = packing.with_shards(rows, 1000)
    assert "NestedLoop" not in placed._jdf.queryExecution().executedPlan().toString()
    assert packing.with_shards(rows.limit(0), 1000).count() == 0
