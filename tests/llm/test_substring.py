import random

import numpy as np
import pyarrow as pa

from lexigrade.llm import substring


def layout(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def prose(rng, words):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(words))


def slow_cuts(data, cut_of_64, longest):
    """One text, byte by byte."""
    gear = [int(g) for g in substring.GEAR]
    ends, last = [], 0
    for i in range(len(data)):
        h = sum(gear[data[i - k]] << k for k in range(min(16, i + 1))) % 2**32
        if (data[i] <= 0x20 and i + 1 >= 16 and (h >> 10) % 64 < cut_of_64) or i + 1 == len(data):
            while i + 1 - last > longest:
                last += longest
                while last < i + 1 and data[last] & 0xC0 == 0x80:
                    last += 1
                if last < i + 1:
                    ends.append(last)
            ends.append(i + 1)
            last = i + 1
    return sorted(set(ends))


def test_cuts_match_byte_by_byte():
    rng = random.Random(1)
    texts = [prose(rng, 300), "", "a", "é" * 700, prose(rng, 20), " " * 50, "日本 " * 400]
    raw, offsets = layout(texts)
    got = substring.cuts(raw, offsets, 13, 256).tolist()
    want = [int(o) + e for t, o in zip(texts, offsets) for e in slow_cuts(t.encode(), 13, 256)]
    assert got == want


def test_cuts_resist_insertions():
    rng = random.Random(2)
    body = prose(rng, 400)
    moved = "Something new. " + body[:900] + " inserted " + body[900:]
    chunks = []
    for text in (body, moved):
        ends = [0, *slow_cuts(text.encode(), 13, 4096)]
        chunks.append({text[a:b] for a, b in zip(ends, ends[1:])})
    assert len(chunks[0] - chunks[1]) <= 4


def test_shared_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(3)
    shared = [prose(rng, n) for n in (60, 80, 120, 200)]
    rows, planted = [], set()
    for i in range(400):
        parts = [prose(rng, rng.randint(20, 300)), prose(rng, rng.randint(0, 100))]
        if i % 4 == 0:
            parts.insert(1, shared[i // 4 % 4])
            planted.add(i)
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in substring.deduplicate(docs.sort("doc_id")).collect()}
    assert {d for d, r in got.items() if r["repeated"]} == planted
    for i, text in rows:
        data, r = text.encode(), got[i]
        kept = bytearray()
        at = 0
        for s in r["spans"]:
            kept += data[at : s["start"]]
            at = s["end"]
        assert (kept + data[at:]).decode() == r["text"]
        assert r["n_removed"] == len(data) - len(r["text"].encode())
        assert bool(r["spans"]) == (i in planted and i >= 16)


def test_equal_texts_stay_once(spark):
    rng = random.Random(4)
    text = prose(rng, 90)
    twice = prose(rng, 60)
    rows = [(1, text), (2, text), (3, text + " " + text), (4, prose(rng, 50)), (5, twice + " " + twice)]
    got = {r["doc_id"]: r for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[1]["text"] == text and got[1]["repeated"]
    assert got[2]["text"] == ""
    for k in (4, 5):  # nothing shared with another text
        assert got[k]["text"] == rows[k - 1][1] and not got[k]["repeated"]


def test_odd_rows(spark):
    rows = [(1, None, 1), (None, "", 2), (2, "a b", 3), (2, "a b", 3), (3, "x" * 100_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").selectExpr("*", "1 as digest")
    got = substring.deduplicate(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["repeated"]) for r in got) == [
        (0, "", False), (1, "", False), (2, "a b", False), (2, "a b", False), (3, "x" * 100_000, False)
    ]
    assert substring.deduplicate(docs.limit(0)).count() == 0


def plain_windows(text, min_words):
    """Spans of the windows of a spaced text."""
    data = text.encode()
    ends = slow_cuts(data, 13, 4096)
    spans = list(zip([0, *ends], ends))

    def words(a, b):
        before = data[:a][-1:]
        return len(data[a:b].split()) - (before > b" " and data[a : a + 1] > b" " if before else 0)

    out = []
    for i, (a, _) in enumerate(spans):
        reach = [b for _, b in spans[i:] if words(a, b) >= min_words]
        if reach:
            out.append((a, reach[0]))
    return out + ([(out[-1][0], len(data))] if out and out[-1][1] < len(data) else [])


def test_windows_by_definition():
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (300, 17, 18, 40)] + ["", "  " * 300 + prose(rng, 30) + " " * 99]
    raw, offsets = layout(texts)
    w = substring.windows(raw, offsets, 18)
    got = sorted((int(w.doc[f]), int(w.begin[f] - offsets[w.doc[f]]), int(w.end[z] - offsets[w.doc[f]])) for f, z in zip(w.first, w.last))
    assert got == sorted((k, a, b) for k, text in enumerate(texts) for a, b in plain_windows(text, 18))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["row", "text"])
    rows = substring.window_rows(batch, 18).to_pandas()
    same = {}
    for (k, a, b), digest in zip(sorted(got), rows.sort_values(["row", "place"]).digest):
        same.setdefault(texts[k].encode()[a:b], set()).add(digest)
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_stitched_lines_stay(spark):
    """Texts made of short lines that each stand in another row: nothing stood together anywhere."""
    rng = random.Random(9)
    lines = [prose(rng, 9) + "\n" for _ in range(600)]
    rows = [(i, prose(rng, 30) + "\n" + line + prose(rng, 30)) for i, line in enumerate(lines)]
    rows += [(1000 + i, "".join(rng.sample(lines, 8))) for i in range(200)]
    got = substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not [r["doc_id"] for r in got if r["repeated"] or r["spans"]]


def test_against_all_pairs_of_windows(spark):
    rng = random.Random(10)
    parts = [prose(rng, rng.randint(5, 60)) for _ in range(12)]
    texts = [" ".join(rng.sample(parts, rng.randint(1, 5)) + [prose(rng, rng.randint(0, 30))]) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in substring.deduplicate(docs).collect()}

    def chunks_in(text, a, b):
        """The window's chunks: near a text's beginning the same bytes may be cut otherwise."""
        ends = [e for e in slow_cuts(text.encode(), 13, 4096) if a < e <= b]
        return tuple(text.encode()[x:y] for x, y in zip([a, *ends], ends))

    found = [[(chunks_in(text, a, b), a, b) for a, b in plain_windows(text, 18)] for text in texts]
    for i, mine in enumerate(found):
        others = [{w for w, _, _ in found[j]} for j in range(len(texts))]
        assert got[i]["repeated"] == any(w in others[j] for w, _, _ in mine for j in range(len(texts)) if j != i)
        gone = set()
        for w, a, b in mine:
            if any(w in others[j] for j in range(i)):
                gone |= set(range(a, b))
        assert {k for s in got[i]["spans"] for k in range(s["start"], s["end"])} == gone


def unspaced(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def test_texts_without_spaces(spark):
    rng = random.Random(5)
    han, thai, code = [chr(c) for c in range(0x4E00, 0x5000)], [chr(c) for c in range(0xE01, 0xE2F)], list("abcdefgh(){};=.,+")
    rows, want = [], {}
    for letters in (han, thai, code):
        k, body = len(rows), unspaced(rng, letters, 6000)
        short, passage = unspaced(rng, letters, 300), unspaced(rng, letters, 400)
        rows += [(k, body), (k + 1, body), (k + 2, body[:2000] + letters[7] + body[2000:]), (k + 3, short), (k + 4, short)]
        rows += [(k + 5, unspaced(rng, letters, 500) + passage + unspaced(rng, letters, 500)), (k + 6, unspaced(rng, letters, 333) + passage)]
        rows += [(k + 7, unspaced(rng, letters, 3000))]
        want |= {k + i: i != 7 for i in range(8)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in substring.deduplicate(docs).collect()}
    assert {d: r["repeated"] for d, r in got.items()} == want
    for k in range(0, len(rows), 8):
        assert [got[k + i]["text"] for i in (0, 3, 5, 7)] == [rows[k + i][1] for i in (0, 3, 5, 7)]
        assert got[k + 1]["text"] == got[k + 4]["text"] == ""
        # An inserted character costs the chunk around it, not what follows.
        assert 0 < len(got[k + 2]["text"]) < 400
        assert len(got[k + 6]["text"]) < 333 + 250


def test_long_words_cut_at_characters():
    rng = random.Random(6)
    texts = [unspaced(rng, "日本語を書く文字", 500), "a " + unspaced(rng, "éüxyz", 900), prose(rng, 50)]
    raw, offsets = layout(texts)
    ends = substring.cuts(raw, offsets)
    assert np.diff(ends, prepend=0).max() < 1000
    for a, b in zip(np.append(0, ends), ends):
        raw[a:b].tobytes().decode()
    assert ends[ends > offsets[2]].tolist() == [int(offsets[2]) + e for e in slow_cuts(texts[2].encode(), 13, 4096)]
