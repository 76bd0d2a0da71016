"""Merkle manifest of a dataset, with nested-interval labels.

Every node of a tree carries the interval of leaf ranks it covers and the level it stands on.
A node's ancestor on a level is the one whose interval contains the node's, and as the intervals
of a level are cut at multiples of one width, containment is an equi-join on (group, low end
over width). The siblings of a node are what its parent's children cover beside the
node's own interval.

Two trees make a manifest: one over the leaves of each source, one over the sources' subroots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrade.llm.common import UPPER, cut

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One step from a node to its parent: hashes of the siblings before and behind it.
PATH = "array<struct<before:string,behind:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other, digests as hex text."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_rows(docs: DataFrame) -> DataFrame:
    """doc_id, group, leaf and altered (the leaf of the row as it would be tampered with, null where it is not).

    `group` stands for the source and sorts as it does: null first, then by UTF-8 bytes.
    """
    doc, source, lang, chars, text = (docs[name] for name in FIELDS)
    head = [field(doc), field(source), field(lang), field(chars)]
    picked = F.crc32(doc.cast("string").cast("binary")) % 5 == 0
    return docs.select(
        doc.alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("group"),
        digest(*head, field(text)).alias("leaf"),
        F.when(picked, digest(*head, field(F.translate(text, UPPER, UPPER.lower())))).alias("altered"),
    )


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """A written copy of `rows` with `lo`, the gapless rank from 0 within its group by `order`, and `size`, the group's rows.

    Rows are dealt to tasks by ranges of (group, order, number), so neither a large group nor
    equal rows stay together; what a task holds of a group begins where the tasks before it end.
    """
    keys = ["group", *order, "_number"]
    numbered = cut(rows.withColumn("_number", F.monotonically_increasing_id()))
    spread = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = cut(spread.drop("_number").withColumn("_at", at).withColumn("_task", F.shiftright("_at", 33)))
    held = placed.groupBy("group", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    tasks = Window.partitionBy("group").orderBy("_task")
    before = F.coalesce(F.sum("_rows").over(tasks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.sum("_rows").over(Window.partitionBy("group"))
    starts = held.select("group", "_task", (F.col("_first") - before).alias("_zero"), size.alias("size"))
    out = placed.join(starts, ["group", "_task"])
    return cut(out.select(*rows.columns, (F.col("_at") - F.col("_zero")).alias("lo"), "size"))


def low(level: int, fan: int) -> Column:
    """Where on `level` the interval that contains a node begins, in widths of the level."""
    return F.expr(f"lo div {fan**level}L")


def run_nodes(below: DataFrame, level: int, fan: int) -> DataFrame:
    """Nodes of `level` (group, lo, hi, size, hash, children) over those of the level below: runs of `fan`, the last one shorter.

    `size` is how many nodes of the level their group has. Groups of a single node are done.
    """
    children = F.array_sort(F.collect_list(F.struct("lo", "hi", "hash")))
    runs = below.where("size > 1").groupBy("group", low(level, fan).alias("_run"), "size").agg(children.alias("children"))
    hashes = F.array_join(F.col("children.hash"), "")
    return runs.select(
        "group",
        F.col("children")[0]["lo"].alias("lo"),
        F.element_at("children", -1)["hi"].alias("hi"),
        F.expr(f"(size + {fan - 1}) div {fan}").alias("size"),
        F.sha2(hashes, 256).alias("hash"),
        "children",
    )


def grow(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """Levels of the trees over `leaves` (group, lo, size, hash): the leaves with `hi`, then written levels of nodes.

    The driver learns the size of the largest group, which tells how many levels there are.
    """
    levels = [leaves.withColumn("hi", F.col("lo") + 1)]
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        levels.append(cut(run_nodes(levels[-1], len(levels), fan)))
        largest = -(-largest // fan)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """The last node of every group: group, hash."""
    out = None
    for level in levels:
        top = level.where("size = 1").select("group", "hash")
        out = top if out is None else out.unionByName(top)
    return out


def attach(levels: list[DataFrame], fan: int, onward: DataFrame, carried: list[str], keep: list[str]) -> DataFrame:
    """Leaves (group and the columns `keep`) with `path`, their steps to the root, and the columns `carried`.

    `onward` (group, path, carried) says how it goes on from each group's top. From the highest level
    down every node meets the one that contains it, so the leaves are joined once, whatever the height.
    """
    over = None
    for number in reversed(range(len(levels))):
        nodes = levels[number]
        columns = ["group", *(("lo", "children") if number else keep)]
        found = nodes.where("size = 1").join(onward, "group").select(*columns, *carried, "path")
        if over is not None:
            run = low(number + 1, fan).alias("_run")
            parents = over.select("group", run, F.col("children").alias("_beside"), F.col("path").alias("_on"), *carried)
            inner = nodes.where("size > 1").withColumn("_run", run).join(parents, ["group", "_run"])
            before = F.filter("_beside", lambda c: c["hi"] <= F.col("lo"))["hash"]
            behind = F.filter("_beside", lambda c: c["lo"] >= F.col("hi"))["hash"]
            step = F.struct(F.array_join(before, "").alias("before"), F.array_join(behind, "").alias("behind"))
            inner = inner.withColumn("path", F.concat(F.array(step), F.col("_on")))
            found = inner.select(*columns, *carried, "path").unionByName(found)
        over = found
    return over


def proof(path: Column) -> Column:
    """SHA-256 of all siblings' hashes from the leaf to the root, each level's from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["behind"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda at, s: digest(s["before"], at, s["behind"]))


def manifest(docs: DataFrame, fan: int = FAN) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """The leaves of `docs` with their paths, the levels of the sources' trees, and those of the tree over the sources.

    Leaves: doc_id, leaf, altered, subroot, root, path. A level has group (the source behind `=`, empty
    for null), lo, hi (the ranks it covers), size, hash and from the second on children.
    """
    if fan < 2:
        raise ValueError("a run needs two nodes at least")
    leaves = ranked(leaf_rows(docs), "doc_id", "leaf").withColumnRenamed("leaf", "hash")
    levels = grow(leaves, fan)
    subroots = tops(levels).select(F.lit("").alias("group"), F.col("group").alias("key"), "hash")
    upper = grow(ranked(subroots, "key"), fan)
    onward = tops(upper).select("group", F.col("hash").alias("root"), F.array().cast(PATH).alias("path"))
    sources = attach(upper, fan, onward, ["root"], ["key", "hash"])
    onward = sources.select(F.col("key").alias("group"), F.col("hash").alias("subroot"), "root", "path")
    proved = attach(levels, fan, onward, ["subroot", "root"], ["doc_id", "hash", "altered"])
    return proved.withColumnRenamed("hash", "leaf").drop("group"), levels, upper


def audit(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Rows of `docs` (doc_id, source, lang, n_chars, text) as doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A null in any field is `-` in its leaf, an empty text `0:`; texts are hashed whole where they are
    read and travel no further. Repeated ids are separate leaves in the order of their hashes, a null
    id comes first and is never tampered with, equal rows are interchangeable. A null source is a source
    of its own, before the empty one. Other columns are not read; an empty table gives no rows.
    """
    proved, _, _ = manifest(docs, fan)
    folded = fold(F.coalesce("altered", "leaf"), F.col("path"))
    out = proved.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
