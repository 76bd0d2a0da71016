import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexigrade.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACE = " \t\n\v\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def mendings(rows):
    """All edits that may be cheapest, as (cost, audit, lines), by trying each; rows are (role, text, must_go, truncated)."""
    best = None
    stack = [(0, 0, "", (), 0)]
    while stack:
        i, cost, audit, lines, inserted = stack.pop()
        if best is not None and cost > best[0]:
            continue
        initials = "".join(r[:1] or "-" for r, _ in lines)
        tail = initials[1:] if initials[:1] == "s" else initials
        if any(c != "ua"[k % 2] for k, c in enumerate(tail)):
            continue
        if i == len(rows) and (not initials or (tail and len(tail) % 2 == 0)):
            found = (cost, audit, lines)
            best = found if best is None or found[:2] < best[:2] else best
        if inserted < 2:
            for role in ("user", "assistant"):
                stack.append((i, cost + 3, audit + "I", (*lines, (role, "")), inserted + 1))
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            stack.append((i + 1, cost + 4, audit + "D", lines, 0))
            if not must_go:
                stack.append((i + 1, cost + 3 * truncated, audit + "K", (*lines, (role, text)), 0))
                for new in ("user", "assistant"):
                    stack.append((i + 1, cost + 3 + 3 * truncated, audit + "R", (*lines, (new, text)), 0))
    return best


def brute_force(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        kept = conversations.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = []
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, sha(f"{len(r[1].encode())}:{r[1]}{r[2]}")))
        turns = {t for t, _, _ in kept if t is not None}
        counts, earlier, marked = [0, 0, 0], set(), []
        for _, role, text in kept:
            said = text.strip(SPACE)
            fault = 0 if not said else 1 if (role, text) in earlier else 2 if said[-1] not in ".!?" else None
            earlier.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, lines = mendings(marked)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in lines))))
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=repr)


def random_rows(rng, conversations, longest=7):
    rows = []
    for conv in range(conversations):
        for _ in range(rng.randint(1, longest)):
            turn = rng.choice([None, *range(5)])
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "No?", "well", " ", "", None, "a. \n", "b!x", " "])))
    return rows


def test_against_all_edits(spark):
    rows = random_rows(random.Random(7), 250)
    got = result(repair.mend(spark.createDataFrame(rows, SCHEMA)))
    for found, want in zip(got, brute_force(rows), strict=True):
        assert found == want


def test_given_conversations(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert result(repair.mend(frame)) == brute_force(rows)


def best_string(rows):
    """The dynamic program with whole strings, for conversations too long to try everything."""
    none = (10**9, "")
    e, s, u, a = (0, ""), none, (3, "I"), (6, "II")

    def add(state, cost, letter):
        return (state[0] + cost, state[1] + letter)

    for role, must_go, truncated in rows:
        c, fee, before = role[:1], 3 * truncated, (e, s, a)
        ne, ns, nu, na = add(e, 4, "D"), [add(s, 4, "D")], [add(u, 4, "D")], [add(a, 4, "D")]
        if not must_go:
            ns += [add(e, fee, "K")] * (c == "s")
            nu += [add(x, fee + 3, "R") for x in before] + [add(x, fee, "K") for x in before if c == "u"]
            na += [add(u, fee + 3, "R")] + [add(u, fee, "K")] * (c == "a")
        e, s = ne, min(ns)
        u = min([*nu, add(e, 3, "I"), add(s, 3, "I"), add(min(na), 3, "I")])
        a = min(min(na), add(u, 3, "I"))
    return min(e, a)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7])
@pytest.mark.parametrize("nodes", [1 << 14, 40])
def test_long_conversations(monkeypatch, modulus, nodes):
    """Few nodes let trees be cut often; a tiny modulus makes most hashes collide."""
    monkeypatch.setattr(repair.Trails, "modulus", modulus)
    monkeypatch.setattr(repair, "NODES", nodes)
    rng = random.Random(3)
    for roles in (["user", "assistant"], ["tool"], ["user", "tool", "system"], ["system"], ["assistant", "user", "user"]):
        for gone in (0.0, 0.3, 1.0):
            rows = [(rng.choice(roles), rng.random() < gone, rng.random() < 0.2) for _ in range(300)]
            mending = repair.Mending()
            for role, must_go, truncated in rows:
                mending.row(role, "t", must_go, truncated)
            assert mending.result()[:2] == best_string(rows)


def test_order_of_strings():
    rng = random.Random(5)
    for modulus in ((1 << 61) - 1, 3):
        trails = type("Small", (repair.Trails,), {"modulus": modulus})()
        strings = {0: ""}
        for _ in range(300):
            node = rng.choice(list(strings))
            letter = rng.choice("DIKR")
            strings[trails.extend(node, letter)] = strings[node] + letter
        for a, b in itertools.islice(itertools.product(strings, strings), 20_000):
            assert trails.less(a, b) == (strings[a] < strings[b])


def test_odd_rows(spark):
    long = "word " * 300_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (1, 2, "user", long), (None, None, None, None), (None, 3, "user", "A."),
            (3, 1, "user", "same."), (3, 1, "user", "same."), (3, 1, "assistant", "x."), (4, -(1 << 63), "user", "a."), (4, (1 << 63) - 1, "user", "b.")]
    rows += [(9, t, "user", "ok.") for t in range(40)] + [(10, None, "user", "ok."), (10, 2, "user", "ok.")]
    rows += [(c, 0, "user", "a.") for c in range(1000, 1060)]
    frame = spark.createDataFrame(rows, SCHEMA)
    small = [r for r in rows if r[0] not in (9, 4)]
    got = result(repair.mend(frame.withColumns({n: F.lit(1) for n in ("DIGEST", "copies", "audit", "_conv", "_first")})))
    assert [r for r in got if r[0] not in (9, 4)] == brute_force(small)
    assert {r[0] for r in got} == {r[0] for r in rows}
    empty = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert [r[1:] for r in got if r[0] and r[0] >= 1000 and zlib.crc32(f"{r[0]}:0".encode()) % 20 == 0].count(empty) >= 1
    assert next(r for r in got if r[0] == 4)[1] <= (1 << 63) - 1
    assert repair.mend(frame.limit(0)).count() == 0
