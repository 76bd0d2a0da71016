"""Structure of damaged conversations: faults, and the cheapest edits that mend the order of roles.

A conversation's rows are streamed in order through a dynamic program over the state that the
mended roles are in (nothing yet, system, user, assistant). Each state keeps its cheapest edits as a
node in a tree of shared prefixes. Nodes know their ancestors at distances of powers of two and a
rolling hash of their prefix, so equally cheap edits are compared at the end of their longest common
prefix; equal hashes count only once the letters are found equal. A state also carries the
running digest of its mended text, so that no text is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrade.llm.common import bounded

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\v\f\r"
#: How much more than the assistant state's a cost may be before its state can't win: an edit that
#: starts over (keeping a system row) saves a deletion at most.
LEAD = DELETE
#: Nodes a tree may have before those no state needs are dropped.
NODES = 1 << 14

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Trails:
    """Strings of edit initials as nodes that share their prefixes; node 0 is the empty string."""

    base, modulus = 1_000_003, (1 << 61) - 1

    def __init__(self) -> None:
        self.begin()
        self.settled: list[str] = []  # what all live strings begin with, in pieces

    def begin(self) -> None:
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.lifts: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... letters up
        self.equal: set[tuple[int, int]] = set()

    def extend(self, node: int, letter: str) -> int:
        lifts, at, k = [], node, 0
        while True:
            lifts.append(at)
            if k >= len(self.lifts[at]):
                break
            at, k = self.lifts[at][k], k + 1
        self.lifts.append(lifts)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(letter)) % self.modulus)
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while (up := self.depth[node] - depth) > 0:
            node = self.lifts[node][up.bit_length() - 1]
        return node

    def letters(self, node: int, stop: int = 0) -> str:
        """What stands between the ancestor `stop` and the node."""
        out = []
        while node != stop:
            out.append(self.letter[node])
            node = self.lifts[node][0]
        return "".join(reversed(out))

    def verified(self, a: int, b: int) -> bool:
        """Whether nodes of one depth with equal hashes hold equal strings."""
        pairs = []
        while a != b and (a, b) not in self.equal:
            if self.letter[a] != self.letter[b]:
                return False
            pairs.append((a, b))
            a, b = self.lifts[a][0], self.lifts[b][0]
        self.equal.update(pairs)
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string at `a` comes before the one at `b`; a prefix comes before what it begins."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y]:
            if self.verified(x, y):
                return self.depth[a] < self.depth[b]
            return self.letters(a) < self.letters(b)
        for k in reversed(range(len(self.lifts[x]))):
            # Both stay equally deep, and the higher they get the fewer ancestors they have.
            if k < len(self.lifts[x]) and self.hash[self.lifts[x][k]] != self.hash[self.lifts[y][k]]:
                x, y = self.lifts[x][k], self.lifts[y][k]
        if self.verified(self.lifts[x][0], self.lifts[y][0]):
            return self.letter[x] < self.letter[y]
        return self.letters(a) < self.letters(b)

    def compact(self, live: list[int]) -> list[int]:
        """Settle what the live nodes share and keep only what lies below it; returns their new numbers."""
        shallow = min(self.depth[n] for n in live)
        at = [self.ancestor(n, shallow) for n in live]
        while len(set(at)) > 1:
            at = [self.lifts[n][0] for n in at]
        root = at[0]
        self.settled.append(self.letters(root))
        paths = [self.letters(n, root) for n in live]
        self.begin()
        index: dict[tuple[int, str], int] = {}
        out = []
        for path in paths:
            node = 0
            for letter in path:
                if (node, letter) not in index:
                    index[node, letter] = self.extend(node, letter)
                node = index[node, letter]
            out.append(node)
        return out

    def text(self, node: int) -> str:
        return "".join(self.settled) + self.letters(node)


class Mending:
    """The dynamic program over one conversation's rows."""

    def __init__(self) -> None:
        self.trails = Trails()
        # For each state cost, node and digest of the mended text.
        self.states: list[tuple | None] = [(0, 0, hashlib.sha256()), None, None, None]
        self.limit = NODES
        self._insert(self.states)

    def _offer(self, best: list, state: int, cost: int, node: int, letter: str, digest, line: bytes | None) -> None:
        held = best[state]
        if held is not None and held[0] <= cost:
            if held[0] < cost:
                return
            # Cost and string belong together, so neither string begins the other.
            if held[1] == node:
                if held[2] <= letter:
                    return
            else:
                trails = self.trails
                if not trails.less(trails.extend(node, letter), trails.extend(held[1], held[2])):
                    return
        best[state] = (cost, node, letter, digest, line)

    def _take(self, offered: tuple) -> tuple:
        cost, node, letter, digest, line = offered
        if line is not None:
            digest = digest.copy()
            digest.update(line)
        return cost, self.trails.extend(node, letter), digest

    def _insert(self, states: list) -> None:
        """Let inserted rows lead from state to state (two in a row at most: more come back to where they were)."""
        for target, sources, name in ((USER, (NOTHING, SYSTEM, ASSISTANT), b"user:"), (ASSISTANT, (USER,), b"assistant:")):
            best: list = [None] * 4
            for source in sources:
                if states[source] is not None:
                    cost, node, digest = states[source]
                    self._offer(best, target, cost + INSERT, node, "I", digest, name if source == NOTHING else b"\n" + name)
            if best[target] is not None and self._better(best[target], states[target]):
                states[target] = self._take(best[target])

    def _better(self, offered: tuple, held: tuple | None) -> bool:
        if held is None or offered[0] != held[0]:
            return held is None or offered[0] < held[0]
        return self.trails.less(self.trails.extend(offered[1], offered[2]), held[1])

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best: list = [None] * 4
        for state, held in enumerate(self.states):
            if held is None:
                continue
            cost, node, digest = held
            self._offer(best, state, cost + DELETE, node, "D", digest, None)
            if must_go:
                continue
            cost += TRUNCATED * truncated
            part = b"" if state == NOTHING else b"\n"
            target, name = (ASSISTANT, "assistant") if state == USER else (USER, "user")
            self._offer(best, target, cost + REROLE, node, "R", digest, (part, name, text))
            kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1])
            if kept == target or (kept == SYSTEM and state == NOTHING):
                self._offer(best, kept, cost, node, "K", digest, (part, role, text))
        lines: dict[tuple, bytes] = {}
        states = []
        for offered in best:
            if offered is not None and offered[4] is not None:
                if offered[4] not in lines:
                    part, name, said = offered[4]
                    lines[offered[4]] = part + f"{name}:{said}".encode()
                offered = (*offered[:4], lines[offered[4]])
            states.append(offered and self._take(offered))
        self._insert(states)
        for state in (NOTHING, SYSTEM):
            if states[state] is not None and states[ASSISTANT] is not None and states[state][0] > states[ASSISTANT][0] + LEAD:
                states[state] = None
        self.states = states
        if len(self.trails.letter) > self.limit:
            live = [k for k, s in enumerate(states) if s is not None]
            nodes = self.trails.compact([states[k][1] for k in live])
            for k, node in zip(live, nodes):
                states[k] = (states[k][0], node, states[k][2])
            self.limit = max(NODES, 2 * len(self.trails.letter))

    def result(self) -> tuple[int, str, str]:
        """Cost, edits and digest of the cheapest mending, of equally cheap ones the least."""
        done = [s for s in (self.states[NOTHING], self.states[ASSISTANT]) if s is not None]
        best = done[0]
        if len(done) > 1 and (done[1][0] < best[0] or (done[1][0] == best[0] and self.trails.less(done[1][1], best[1]))):
            best = done[1]
        return best[0], self.trails.text(best[1]), best[2].hexdigest()


class Conversation:
    """One conversation's faults and mending, fed with its rows in order."""

    def __init__(self) -> None:
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        self.mending: Mending | None = None

    def row(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        self.mending = self.mending or Mending()
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        said = text.rstrip(SPACE)
        blank, cut_off = not said, said[-1:] not in (".", "!", "?")
        self.blank += blank
        self.duplicate += seen and not blank
        truncated = cut_off and not blank and not seen
        self.truncated += truncated
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        self.mending.row(role, text, blank or seen, truncated)

    def result(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        mended = self.mending.result() if self.mending else (0, "", hashlib.sha256().hexdigest())
        return min(gaps, (1 << 63) - 1), self.blank, self.duplicate, self.truncated, self.illegal, *mended


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest and `copies`: what the damage leaves of each row (0 to 2 of it).

    The CRC-32 of `conv_id:turn` modulo 20 tells a row's fate: 0 drops it, 1 empties its text, 2 takes
    the marks `.!?` out of it, 3 repeats it, 4 makes its role user. Nulls read as one space.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(conversations[name].cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(fate.isin(0, 1), "").when(fate == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(fate == 4, "user").when(fate == 0, "").otherwise(spaced("role"))
    rows = conversations.select(
        conversations["conv_id"],
        conversations["turn"],
        role.alias("role"),
        text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("digest", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def said_before(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest of what an earlier turn of the conversation has said in the same role.

    Only digests are shuffled, one for each turn; those of a first or only turn go again before the join.
    """
    said = rows.where(F.col("copies") > 0).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    said = said.select("conv_id", "turn", "digest").distinct()
    span = said.groupBy("conv_id", "digest").agg(
        F.min("turn").alias("_first"), F.max("turn").alias("_last"), F.max(F.col("turn").isNull()).alias("_null")
    )
    again = span.where((F.col("_first") < F.col("_last")) | (F.col("_null") & F.col("_last").isNotNull()))
    again = again.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "_first", "_null")
    met = said.join(again, said["conv_id"].eqNullSafe(again["_conv"]) & (said["digest"] == again["_digest"]))
    return met.where(F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_first")))).select("conv_id", "turn", "digest")


def mend(conversations: DataFrame) -> DataFrame:
    """Every conversation of `conversations` (conv_id, turn, role, text) with the faults its damaged rows have and their mending.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows are taken by turn, null
    first; rows of one turn by the digest of role and text, equal ones are each other's copies. Nulls in other columns read as one space, so a null
    text is blank; a null or empty role is no one's and can't be kept; a null conv_id is a conversation of its own. One with no rows left has zeros, no edits and the
    digest of nothing. Other columns are not read; an empty table gives no rows.

    A digest of a whole conversation is a chain, so one task reads it; it does so row by row, and holds no text but the row's, whatever its
    length. What was said before is found by joins over all tasks and comes in as a mark in front of the row. Edits
    that no live state needs are let go, so a conversation holds its audit and what its states differ in.
    """
    rows = damaged(conversations)
    marks = said_before(rows)
    order = ["conv_id", "turn", "digest", "copies"]
    mark = marks.select("conv_id", "turn", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(-1).alias("copies"), "digest")
    dealt = rows.unionByName(mark).repartition("conv_id").sortWithinPartitions(*order)
    kind = conversations.schema["conv_id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *(c.split()[0] for c in RESULT.split(", "))]
        kinds = [None, *[pa.int64()] * 6, pa.string(), pa.string()]
        now = mark = last = open_ = None
        for batch in bounded(batches, "text"):
            out = []
            kinds[0] = batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "digest"))
            for conv, turn, role, text, copies, digest in zip(*columns):
                if open_ is None or conv != now:
                    if open_ is not None:
                        out.append((now, *open_.result()))
                    now, open_, mark, last = conv, Conversation(), None, None
                if copies < 0:
                    mark = (turn, digest)
                for _ in range(copies):
                    open_.row(turn, role, text, (turn, digest) in (mark, last))
                    last = (turn, digest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((now, *open_.result()), kinds)], names=names)

    return dealt.mapInArrow(scan, f"conv_id {kind.simpleString()}, {RESULT}")
