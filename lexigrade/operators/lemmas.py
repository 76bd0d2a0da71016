"""Lemmas of unseen words by rules on their endings, learned from a dictionary.

A rule strips some letters of a word's end and adds others. A dictionary entry votes for its rule under
the endings of several lengths that its word has; an unseen word takes the rule of the longest of its
endings that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrade.operators.joins import lookup_join

#: Letters of a word that an ending may hold beyond those its rule strips, and letters of an ending at most.
CONTEXT, LONGEST = 3, 8


def _endings(word: str, shortest: Column, longest: Column) -> Column:
    lengths = F.when(shortest <= longest, F.sequence(shortest, longest))
    return F.transform(lengths, lambda n: F.right(F.col(word), n))


def learn_rules(dictionary: DataFrame, context: int = CONTEXT, longest: int = LONGEST) -> DataFrame:
    """(suffix, strip, add, votes) from (token, lemma): for every ending the rule most entries have.

    Of rules with equal votes the one that strips least, then the one that adds the least string, is taken. A rule that
    strips more than `longest` letters is learned by the whole stripped part alone.
    """
    entries = dictionary.where("token IS NOT NULL AND lemma IS NOT NULL AND token <> ''").select("token", "lemma").distinct()
    shared = F.filter(
        F.sequence(F.lit(0), F.least(F.length("token"), F.length("lemma"))),
        lambda n: F.left(F.col("token"), n) == F.left(F.col("lemma"), n),
    )
    ruled = entries.withColumn("_n", F.array_max(shared)).select(
        "token",
        (F.length("token") - F.col("_n")).alias("strip"),
        F.expr("substring(lemma, _n + 1)").alias("add"),
    )
    first = F.greatest(F.col("strip"), F.lit(1))
    last = F.least(F.length("token"), F.greatest(F.least(F.col("strip") + context, F.lit(longest)), first))
    votes = ruled.select(F.explode(_endings("token", first, last)).alias("suffix"), "strip", "add")
    counted = votes.groupBy("suffix", "strip", "add").agg(F.count("*").alias("votes"))
    best = F.min_by(F.struct("strip", "add", "votes"), F.struct(-F.col("votes"), "strip", "add"))
    return counted.groupBy("suffix").agg(best.alias("r")).select("suffix", "r.*")


def lemmatise(tokens: DataFrame, dictionary: DataFrame, rules: DataFrame, longest: int = LONGEST, **bounds) -> DataFrame:
    """(token, lemma, source) for each distinct word of `tokens` (token): by `dictionary`, by `rule`, or `itself`.

    The endings of a word are looked up in one pass; endings beyond `longest` letters are tried where a rule strips that many.
    """
    words = tokens.where("token IS NOT NULL AND token <> ''").select("token").distinct()
    known = dictionary.groupBy("token").agg(F.min("lemma").alias("_known"))
    words = words.join(known, "token", "left")
    unseen = words.where("_known IS NULL").select("token")
    widest = rules.agg(F.max(F.length("suffix"))).first()[0] or 0
    reach = F.least(F.length("token"), F.lit(max(longest, widest)))
    endings = unseen.select("token", F.explode(_endings("token", F.lit(1), reach)).alias("suffix"))
    found = lookup_join(endings, rules.select("suffix", "strip", "add"), "suffix", row_key=["token", "suffix"], **bounds)
    chosen = found.where("strip IS NOT NULL").groupBy("token").agg(
        F.max_by(F.struct("strip", "add"), F.length("suffix")).alias("_r")
    )
    made = F.concat(F.expr("left(token, length(token) - _r.strip)"), F.col("_r.add"))
    # A rule that leaves nothing of a word is no help.
    made = F.when(made != "", made)
    return words.join(chosen, "token", "left").select(
        "token",
        F.coalesce("_known", made, "token").alias("lemma"),
        F.when(F.col("_known").isNotNull(), "dictionary").when(made.isNotNull(), "rule").otherwise("itself").alias("source"),
    )
