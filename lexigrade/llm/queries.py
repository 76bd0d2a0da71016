"""The registered queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrade.llm import decontaminate, exact, html_text, language, merkle, packing, pii, quality, repair, shards, simhash, squares, substring
from lexigrade.llm.common import UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(table(spark, sf_dir, "documents")).drop("row")


SQL["op4_exact_dedup"] = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@query
def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


#: ASCII is lower-cased, and what is neither a letter, a digit nor beyond ASCII parts words.
_WORDS = f"string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ')"
SQL["op9_decontaminate"] = f"""
WITH i AS (SELECT item_id, list_filter({_WORDS}, lambda w: w <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, l, array_to_string(w[k:k + l - 1], ' ') AS g
      FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS k
            FROM (SELECT *, least(10, len(w)) AS l FROM i WHERE len(w) > 0))),
d AS (SELECT doc_id, list_filter({_WORDS}, lambda w: w <> '') AS w FROM documents),
h AS (SELECT doc_id, k, g.l, item_id
      FROM (SELECT doc_id, k, l, array_to_string(w[k:k + l - 1], ' ') AS g
            FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS k
                  FROM d, (SELECT DISTINCT l FROM p) WHERE len(w) >= l)) AS g
      JOIN p ON p.l = g.l AND p.g = g.g),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS x FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
      FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


#: Stands in for the key that a deployment takes from its own secret store.
DEMONSTRATION_KEY = b"lexigrade demonstration key"


@query
def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text."""
    step = "lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), {step})), 4294967295)"


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def _leaf(text: str) -> str:
    values = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


def _levels(name: str, leaves: str) -> str:
    """SQL for the nodes (g, level, i, n, h) over leaves (g, i, n, h), and for the steps from node to parent."""
    return f"""
{name} AS (SELECT g, 0 AS level, i, n, h FROM {leaves}
  UNION ALL
  SELECT g, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, level, i // 16, n),
{name}_steps AS (SELECT g, level, i, {{'b': coalesce(string_agg(h, '' ORDER BY i) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    'a': coalesce(string_agg(h, '' ORDER BY i) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')}} AS step
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY g, level, i // 16 ORDER BY i))"""


SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf("text")} AS h,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS altered
  FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
{_levels("t", "k")},
s AS (SELECT '' AS g, g AS source, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{_levels("u", "s")},
p AS (SELECT k.g, k.i, k.doc_id, k.h, k.altered, list(step ORDER BY level) FILTER (step IS NOT NULL) AS steps
      FROM k LEFT JOIN t_steps ON t_steps.g = k.g AND t_steps.i = k.i // (16 ** level)::BIGINT GROUP BY ALL),
q AS (SELECT s.source, s.h, list(step ORDER BY level) FILTER (step IS NOT NULL) AS steps
      FROM s LEFT JOIN u_steps ON u_steps.i = s.i // (16 ** level)::BIGINT GROUP BY ALL),
f AS (SELECT p.doc_id, p.h AS leaf, q.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, p.altered,
             list_concat(coalesce(p.steps, []), coalesce(q.steps, [])) AS steps
      FROM p JOIN q ON q.source = p.g),
r AS (SELECT *, list_reduce(list_concat([{{'b': coalesce(altered, leaf), 'a': ''}}], steps),
                            lambda x, y: {{'b': sha256(y.b || x.b || y.a), 'a': ''}}).b AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.b || x.a), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM r
"""


@query
def op12_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squares.pack(table(spark, sf_dir, "documents"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.mend(table(spark, sf_dir, "conversations"))


def _edit(state: str, cost: str, letter: str) -> str:
    """SQL for a state, its cost in ten digits and its edits, after one more edit; no state stays none."""
    return f"lpad((substr({state}, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({state}, 11) || '{letter}'"


def _from(states: str, cost: str, letter: str) -> str:
    return "least(" + ", ".join(_edit(s, cost, letter) for s in states.split()) + ", NULL)"


SQL["op13_conversation_repair"] = f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations),
x AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
             CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
      FROM d WHERE fate <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text), copy) AS i FROM x),
m AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
             NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut
      FROM n),
g AS (SELECT *, blank OR seen AS go, CASE WHEN cut AND NOT blank AND NOT seen THEN 3 ELSE 0 END AS fee FROM m),
z AS (SELECT conv_id, 0 AS i, '0000000000' AS e, NULL::VARCHAR AS s, '0000000003I' AS u, '0000000006II' AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, e, s, u, least(a, {_edit("u", "3", "I")})
  FROM (SELECT conv_id, i, e, s, least(u, {_from("e s a", "3", "I")}) AS u, a
        FROM (SELECT z.conv_id, g.i, {_edit("e", "4", "D")} AS e,
                     least({_edit("s", "4", "D")}, CASE WHEN NOT go AND c = 's' THEN {_edit("e", "fee", "K")} END) AS s,
                     least({_edit("u", "4", "D")}, CASE WHEN NOT go THEN {_from("e s a", "(3 + fee)", "R")} END,
                           CASE WHEN NOT go AND c = 'u' THEN {_from("e s a", "fee", "K")} END) AS u,
                     least({_edit("a", "4", "D")}, CASE WHEN NOT go THEN {_edit("u", "(3 + fee)", "R")} END,
                           CASE WHEN NOT go AND c = 'a' THEN {_edit("u", "fee", "K")} END) AS a
              FROM z JOIN g ON z.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = z.i + 1))),
y AS (SELECT conv_id, least(e, a) AS best FROM z QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
w AS (SELECT conv_id, substr(best, 1, 10)::BIGINT AS cost, substr(best, 11) AS audit FROM y),
p AS (SELECT conv_id, p, substr(audit, p, 1) AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM w)),
o AS (SELECT *, count(*) FILTER (letter <> 'I') OVER v AS i, count(*) FILTER (letter <> 'D') OVER v AS k FROM p WINDOW v AS (PARTITION BY conv_id ORDER BY p)),
j AS (SELECT o.conv_id, o.p, letter, k, role, text, bool_or(k = 1 AND letter = 'K' AND c = 's') OVER (PARTITION BY o.conv_id) AS led
      FROM o LEFT JOIN g ON o.letter <> 'I' AND o.conv_id IS NOT DISTINCT FROM g.conv_id AND g.i = o.i),
h AS (SELECT conv_id, sha256(string_agg(
        CASE WHEN letter = 'K' THEN role WHEN (k - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END,
        chr(10) ORDER BY p)) AS repaired_sha256
      FROM j WHERE letter <> 'D' GROUP BY conv_id),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
             count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (fee > 0) AS truncated,
             count(*) FILTER (b || c NOT IN ('su', 'ua', 'au')) AS illegal
      FROM g GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM w LEFT JOIN q ON w.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN h ON w.conv_id IS NOT DISTINCT FROM h.conv_id
"""
