"""Building blocks of the checking SQL: named table expressions and their needs."""

from __future__ import annotations

from catalog.fixtures import CYRILLIC, LATIN, TABULAR_SOURCES, VECTOR_SCALE, VOCABULARY
from lexigrade.functions import text as t
from lexigrade.levels import LEVELS

# The same patterns without possessive quantifiers, which this engine does not have.
LETTERS = r"[\p{L}\p{Nl}\p{No}]"
WORD = rf"{LETTERS}+(?:['’\-]{LETTERS}+)*"
SENTENCE = r"[^.!?]+[.!?]*"
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
TERM = r"[\p{L}\p{N}_]{2,}"
NON_BLANK = t.NON_BLANK.removesuffix("+")

BLANKS = "(" + "||".join(f"chr({ord(c)})" for c in t.WHITESPACE) + ")"
LEVEL_LIST = "[" + ",".join(f"'{level}'" for level in LEVELS) + "]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def find_all(x: str, pattern: str) -> str:
    return f"regexp_extract_all({x}, {lit(pattern)})"


def words(x: str) -> str:
    return find_all(x, WORD)


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def strip_lower(x: str) -> str:
    return f"lower({strip(x)})"


def cyrillic(x: str) -> str:
    letters = t.CYRILLIC_LETTERS
    pattern = rf"[{letters}]+(?:['\-][{letters}]+)*"
    return f"regexp_full_match(replace({strip_lower(x)}, '’', ''''), {lit(pattern)})"


def transliterate(x: str) -> str:
    return f"translate(lower({x}), '{LATIN}', '{CYRILLIC}')"


def digest_number(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def bits(x: str) -> str:
    return f"length(bin({x}))"


def length_level(x: str) -> str:
    return f"{LEVEL_LIST}[least(greatest({bits(x)}, 8), 13) - 7]"


def syllables(w: str) -> str:
    groups = f"len(regexp_extract_all(lower({w}), '[{t.VOWELS}]+'))"
    silent = f"({groups} > 1 AND (ends_with(lower({w}), 'e') OR ends_with(lower({w}), 'es')))"
    return f"(CASE WHEN {w} = '' THEN 0 ELSE greatest(1, {groups} - {silent}::INT) END)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0::DOUBLE)"


def digest_prob(x: str, i: int) -> str:
    def weight(k: int) -> str:
        return f"(('0x' || substr(md5({x}), {2 * k + 1}, 2))::BIGINT::DOUBLE + 1)"

    total = "+".join(weight(k) for k in range(len(LEVELS)))
    return f"({weight(i)} / ({total}))"


def digest_probs(x: str) -> str:
    return "[" + ", ".join(digest_prob(x, i) for i in range(len(LEVELS))) + "]"


def top_level(p: str) -> str:
    return f"{LEVEL_LIST}[list_position({p}, list_max({p}))]"


def features(source: str, key: str, text: str, prefix: str = "") -> str:
    """Select the nine text statistics of `text` from `source`."""
    return f"""
    SELECT {key}, sents AS {prefix}sentence_count, toks AS {prefix}token_count,
      types AS {prefix}type_count, nums AS {prefix}number_count, syl AS {prefix}syllable_count,
      {ratio('toks', 'sents')} AS {prefix}average_sentence_length,
      {ratio('types', 'toks')} AS {prefix}type_token_ratio,
      {ratio('syl', 'toks')} AS {prefix}average_syllables_per_word,
      {ratio('longs', 'toks')} * 100 AS {prefix}long_word_percentage
    FROM (SELECT {key}, sents, nums, len(w) AS toks,
            len(list_distinct(list_transform(w, lambda x: lower(x)))) AS types,
            coalesce(list_sum(s), 0)::BIGINT AS syl,
            len(list_filter(s, lambda x: x > 2)) AS longs
          FROM (SELECT *, list_transform(w, lambda x: {syllables('x')}) AS s
                FROM (SELECT {key}, {words(text)} AS w,
                        len(list_filter({find_all(text, SENTENCE)},
                            lambda x: {strip('x')} <> '')) AS sents,
                        len(list_distinct({find_all(text, NUMBER)})) AS nums
                      FROM {source})))"""


# name → (needed names, SQL)
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), f"SELECT doc_id, {transliterate('text')} AS text FROM documents"),
    "turns": (
        (),
        f"SELECT conv_id, turn, role, {transliterate('text')} AS text FROM conversations",
    ),
    "pairs": (
        ("turns",),
        """SELECT a.conv_id * 4294967296 + a.turn AS pair_id, a.role, a.text AS kaz, b.text AS rus
        FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    ),
    "lexicon_raw": (
        (),
        f"""SELECT {digest_number('word')} * 2 + 1 AS row_id, word,
          {LEVEL_LIST}[7 - least({bits('n')}, 6)]
            || CASE WHEN {cyrillic('word')} AND length(word) <= 4 THEN ' ' ELSE '' END AS level
        FROM (SELECT word, count(*) AS n FROM
              (SELECT unnest({words(transliterate('text'))}) AS word FROM benchmark) GROUP BY word)
        UNION ALL
        SELECT {digest_number('word')} * 2, ' ' || upper(word) || chr(9), 'C2'
        FROM (SELECT DISTINCT unnest({words(transliterate('text'))}) AS word FROM benchmark)
        WHERE {cyrillic('word')} AND length(word) <= 4""",
    ),
    "lexicon": (
        ("lexicon_raw",),
        f"""SELECT word, arg_max(level, row_id) AS level FROM
        (SELECT row_id, {strip_lower('word')} AS word, {strip('level')} AS level FROM lexicon_raw)
        WHERE word <> '' GROUP BY word""",
    ),
    "rus_tokens": (
        ("pairs",),
        f"""SELECT pair_id, unnest(range(len(w))) AS word_idx, unnest(w) AS token
        FROM (SELECT pair_id, {words('rus')} AS w FROM pairs)""",
    ),
    "lemmas": (
        ("rus_tokens",),
        f"""SELECT DISTINCT token, substr(token, 1, 5) AS lemma FROM rus_tokens
        WHERE length(token) > 5 AND regexp_matches(token, '[{t.VOWELS}]$')""",
    ),
    "word_lists": (
        ("pairs",),
        f"""SELECT pair_id, 'kaz' AS side, {words('kaz')} AS w FROM pairs
        UNION ALL SELECT pair_id, 'rus', {words('rus')} FROM pairs""",
    ),
    "vectors": (
        (),
        f"""SELECT vec_id, list_transform(embedding,
            lambda x: (x::DOUBLE * CAST('{VECTOR_SCALE!r}' AS DOUBLE))::FLOAT) AS vec
        FROM embeddings""",
    ),
    "text_corpus_raw": (
        (),
        f"""SELECT doc_id, text AS text_en, {transliterate('text')} AS text_ru,
          {length_level('n_chars')} AS label FROM documents""",
    ),
    "text_corpus_gaps": (
        ("text_corpus",),
        "SELECT * FROM text_corpus WHERE doc_id % 50 <> 0",
    ),
    "text_corpus": (
        ("text_corpus_raw",),
        """SELECT doc_id, coalesce(text_en, '') AS text_en, coalesce(text_ru, '') AS text_ru, label
        FROM text_corpus_raw WHERE label IS NOT NULL""",
    ),
    "rus_features": (("pairs",), features("pairs", "pair_id, kaz, rus", "rus")),
    "tabular_raw": (
        ("rus_features",),
        f"""SELECT pair_id, kaz, rus,
          {", ".join(f"{src}::DOUBLE AS {name}" for name, src in TABULAR_SOURCES.items()
                     if name != "avg_sent_len_mean")},
          CASE WHEN sentence_count > 1 THEN average_sentence_length END AS avg_sent_len_mean,
          {ratio(f"list_sum(list_transform({words('rus')}, lambda x: length(x)))",
                 "token_count")} AS avg_word_len_mean,
          (token_count - len({words('kaz')}))::DOUBLE AS align_diff,
          {length_level('length(rus)')} AS predicted_cefr
        FROM rus_features""",
    ),
    "tabular_gaps": (
        ("tabular",),
        "SELECT * FROM tabular WHERE (pair_id >> 32) % 50 <> 0",
    ),
    "tabular": (
        ("tabular_raw",),
        "SELECT * FROM tabular_raw WHERE predicted_cefr IS NOT NULL",
    ),
    "level_predictions": (
        (),
        f"""SELECT doc_id, {length_level('n_chars')} AS label,
          {LEVEL_LIST}[least(greatest({bits(f"len({words('text')})")} + 3, 8), 13) - 7] AS pred
        FROM documents""",
    ),
    "quality_predictions": (
        (),
        """SELECT l.doc_id, l.quality::VARCHAR AS label,
          (d.n_chars > 2000)::INT::VARCHAR AS pred
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    ),
    "class_counts": (
        ("level_predictions",),
        """SELECT label, sum(tp)::BIGINT AS tp, sum(s)::BIGINT AS support,
          sum(p)::BIGINT AS predicted
        FROM (SELECT label, (label = pred)::INT AS tp, 1 AS s, 0 AS p FROM level_predictions
              UNION ALL SELECT pred, 0, 0, 1 FROM level_predictions) GROUP BY label""",
    ),
    "class_scores": (
        ("class_counts",),
        f"""SELECT label, support, {ratio('tp', 'predicted')} AS precision,
          {ratio('tp', 'support')} AS recall, {ratio('2 * tp', 'predicted + support')} AS f1
        FROM class_counts""",
    ),
}


def _alignment_tables(suffix: str, lists: str, max_pieces: int | None = None) -> None:
    """Alignment from word lists to phrases; the suffix tells variants apart."""
    s = suffix
    limit = "" if max_pieces is None else f" WHERE n <= {max_pieces}"
    TABLES[f"pieces{s}"] = (
        (lists,),
        f"""SELECT pair_id, side, word_idx, piece_idx, piece FROM (
          SELECT *, row_number() OVER (PARTITION BY pair_id, side
                                       ORDER BY word_idx, piece_idx) AS n
          FROM (SELECT pair_id, side, word_idx, unnest(range(len(p))) AS piece_idx,
                  unnest(p) AS piece
                FROM (SELECT pair_id, side, word_idx, regexp_extract_all(token, '.{{1,4}}') AS p
                      FROM (SELECT pair_id, side, unnest(range(len(w))) AS word_idx,
                              unnest(w) AS token FROM {lists})))){limit}""",
    )
    TABLES[f"lengths{s}"] = (
        (lists, f"pieces{s}"),
        f"""SELECT l.pair_id, bool_or(coalesce(k.last, -1) < len(l.w) - 1) AS too_long,
          max(CASE WHEN l.side = 'kaz' THEN coalesce(k.n, 0) ELSE 0 END) AS kaz_pieces,
          max(CASE WHEN l.side = 'rus' THEN coalesce(k.n, 0) ELSE 0 END) AS rus_pieces
        FROM {lists} l LEFT JOIN (SELECT pair_id, side, max(word_idx) AS last, count(*) AS n
                                  FROM pieces{s} GROUP BY pair_id, side) k
          ON l.pair_id = k.pair_id AND l.side = k.side GROUP BY l.pair_id""",
    )
    TABLES[f"pooled{s}"] = (
        (f"pieces{s}", "vectors"),
        f"""SELECT pair_id, side, word_idx, list_transform(range(1, len(vecs[1]) + 1),
            lambda i: list_avg(list_transform(vecs, lambda v: v[i]::DOUBLE))) AS vec
        FROM (SELECT pair_id, side, word_idx, list(vec ORDER BY piece_idx) AS vecs
              FROM pieces{s} JOIN vectors
                ON vec_id = {digest_number('piece')} % (SELECT count(*) FROM vectors)
              GROUP BY pair_id, side, word_idx)""",
    )
    TABLES[f"word_pairs{s}"] = (
        (f"pooled{s}", f"lengths{s}", lists),
        f"""SELECT p.*, kw.w[kz + 1] AS kz_token, rw.w[ru + 1] AS ru_token,
          least(p_ru, p_kz) AS joint, p_ru > 0.05 AND p_kz > 0.05 AS is_link
        FROM (SELECT pair_id, kz, ru,
            exp(sim - max(sim) OVER k) / sum(exp(sim - max_k)) OVER k AS p_ru,
            exp(sim - max(sim) OVER r) / sum(exp(sim - max_r)) OVER r AS p_kz
          FROM (SELECT *, max(sim) OVER (PARTITION BY pair_id, kz) AS max_k,
                  max(sim) OVER (PARTITION BY pair_id, ru) AS max_r
                FROM (SELECT a.pair_id, a.word_idx AS kz, b.word_idx AS ru,
                        list_inner_product(a.vec, b.vec) AS sim
                      FROM pooled{s} a JOIN pooled{s} b ON a.pair_id = b.pair_id
                        AND a.side = 'kaz' AND b.side = 'rus'
                      JOIN lengths{s} g ON g.pair_id = a.pair_id AND NOT g.too_long))
          WINDOW k AS (PARTITION BY pair_id, kz), r AS (PARTITION BY pair_id, ru)) p
        JOIN {lists} kw ON kw.pair_id = p.pair_id AND kw.side = 'kaz'
        JOIN {lists} rw ON rw.pair_id = p.pair_id AND rw.side = 'rus'""",
    )
    TABLES[f"links{s}"] = (
        (f"word_pairs{s}",),
        f"SELECT * FROM word_pairs{s} WHERE is_link",
    )
    TABLES[f"phrases{s}"] = _islands(f"links{s}")


def _islands(links: str) -> tuple[tuple[str, ...], str]:
    return (
        (links,),
        f"""SELECT pair_id, ru AS russian_index, min(kz) AS start, any_value(ru_token) AS token,
          string_agg(kz_token, ' ' ORDER BY kz) AS phrase,
          string_agg(kz::VARCHAR, ',' ORDER BY kz) AS span, list(kz ORDER BY kz) AS kz_list,
          count(*) AS n_words, min(joint) AS conf
        FROM (SELECT *, kz - row_number() OVER (PARTITION BY pair_id, ru ORDER BY kz) AS island
              FROM {links}) GROUP BY pair_id, ru, island""",
    )


_alignment_tables("", "word_lists")
_alignment_tables("_short", "word_lists", 256)
#: A public tokenizer's byte strings in hex; the longest of those that a word goes on with is its next piece.
TABLES["vocabulary"] = (
    (),
    f"""SELECT hex(from_base64(piece)) AS piece, piece_id FROM read_csv({lit(VOCABULARY)}, delim = ' ',
      header = false, quote = '', escape = '', columns = {{'piece': 'VARCHAR', 'piece_id': 'BIGINT'}})""",
)
TABLES["spelled"] = (
    ("word_lists", "vocabulary"),
    """SELECT word, k, found AS piece_id FROM (
      WITH RECURSIVE r AS (
        SELECT word, hex(encode(' ' || word)) AS h, 0 AS place, -1 AS k, NULL::BIGINT AS found
        FROM (SELECT DISTINCT unnest(w) AS word FROM word_lists)
        UNION ALL
        SELECT word, h, place + n, k + 1, piece_id FROM (
          SELECT c.*, v.piece_id, row_number() OVER (PARTITION BY word ORDER BY n DESC) AS best
          FROM (SELECT *, unnest(range(2, least(128, length(h) - place) + 1, 2)) AS n FROM r) c
          JOIN vocabulary v ON v.piece = substr(h, place + 1, n)) WHERE best = 1)
      SELECT * FROM r WHERE k >= 0)""",
)


def _subword_tables(suffix: str, max_pieces: int | None = None) -> None:
    """Pieces by the vocabulary, and vectors mixed with those of the pieces beside them."""
    s = suffix
    _alignment_tables(s, "word_lists")
    limit = "" if max_pieces is None else f" WHERE piece_idx < {max_pieces}"
    TABLES[f"pieces{s}"] = (
        ("word_lists", "spelled"),
        f"""SELECT * FROM (SELECT pair_id, side, word_idx, piece_id,
            row_number() OVER (PARTITION BY pair_id, side ORDER BY word_idx, k) - 1 AS piece_idx
          FROM (SELECT pair_id, side, unnest(range(len(w))) AS word_idx, unnest(w) AS word FROM word_lists) l
          JOIN spelled USING (word)){limit}""",
    )
    TABLES[f"pooled{s}"] = (
        (f"pieces{s}", "vectors"),
        f"""SELECT pair_id, side, word_idx, list_transform(range(1, len(vecs[1]) + 1),
            lambda i: list_avg(list_transform(vecs, lambda v: v[i]::DOUBLE))) AS vec
        FROM (SELECT pair_id, side, word_idx, list(list_transform(range(1, len(vec) + 1), lambda i:
              ((0.5::DOUBLE * vec[i] + 0.25::DOUBLE * coalesce(a[i], 0) + 0.25::DOUBLE * coalesce(b[i], 0))
               / (0.5::DOUBLE + CASE WHEN a IS NULL THEN 0 ELSE 0.25 END + CASE WHEN b IS NULL THEN 0 ELSE 0.25 END))::FLOAT)
              ORDER BY piece_idx) AS vecs
            FROM (SELECT p.*, vec, lag(vec) OVER t AS a, lead(vec) OVER t AS b FROM pieces{s} p
                  JOIN vectors ON vec_id = piece_id % (SELECT count(*) FROM vectors)
                  WINDOW t AS (PARTITION BY pair_id, side ORDER BY piece_idx))
            GROUP BY pair_id, side, word_idx)""",
    )


_subword_tables("_sub")
_subword_tables("_sub128", 128)
TABLES["blank_lists"] = (
    ("pairs",),
    f"""SELECT pair_id, 'kaz' AS side, {find_all('kaz', NON_BLANK)} AS w FROM pairs
    UNION ALL SELECT pair_id, 'rus', {find_all('rus', NON_BLANK)} FROM pairs""",
)
_alignment_tables("_blank", "blank_lists")
TABLES["gold"] = (
    ("word_lists",),
    """SELECT pair_id, kz, ru, kaz[kz + 1] AS kz_token, rus[ru + 1] AS ru_token, NULL::DOUBLE AS joint
    FROM (SELECT *, unnest(range(kz, least(kz + 2, len(rus)))) AS ru
          FROM (SELECT k.pair_id, k.w AS kaz, r.w AS rus, unnest(range(len(k.w))) AS kz
                FROM word_lists k JOIN word_lists r
                  ON k.pair_id = r.pair_id AND k.side = 'kaz' AND r.side = 'rus'))""",
)
TABLES["gold_phrases"] = _islands("gold")
def _grading_tables(s: str) -> None:
    """Levels of the phrases with suffix `s`."""
    TABLES[f"graded{s}"] = (
        (f"phrases{s}", "lexicon"),
        f"""SELECT p.*, coalesce(l.level, 'Unknown') AS level, {cyrillic('p.token')} AS is_cyr
        FROM phrases{s} p LEFT JOIN lexicon l ON l.word = {strip_lower('p.token')}""",
    )
    _N = [f"coalesce(n{i}, 0)" for i in range(6)]
    _KNOWN = "(" + "+".join(_N) + ")"
    TABLES[f"level_counts{s}"] = (
        (f"graded{s}", "pairs", f"lengths{s}"),
        f"""SELECT p.pair_id, g.too_long, {", ".join(f"coalesce(n{i}, 0) AS n{i}" for i in range(6))}
        FROM pairs p JOIN lengths{s} g ON g.pair_id = p.pair_id LEFT JOIN (SELECT pair_id,
          {", ".join(f"count(*) FILTER (is_cyr AND level = '{lv}') AS n{i}"
                     for i, lv in enumerate(LEVELS))}
          FROM graded{s} GROUP BY pair_id) c ON c.pair_id = p.pair_id""",
    )
    TABLES[f"shares{s}"] = (
        (f"level_counts{s}",),
        f"""SELECT pair_id, too_long, known, [{", ".join(
            f"CASE WHEN known > 0 THEN n{i}::DOUBLE / known ELSE 0 END" for i in range(6))}] AS dist
        FROM (SELECT *, {"+".join(f"n{i}" for i in range(6))} AS known FROM level_counts{s})""",
    )
    TABLES[f"levels{s}"] = (
        (f"shares{s}",),
        f"""SELECT *, CASE WHEN known > 0 THEN {LEVEL_LIST}[round_even(0.0::DOUBLE + {" + ".join(
            f"{i}.0::DOUBLE * dist[{i + 1}]" for i in range(6))}, 0)::INT + 1]
            ELSE 'Unknown' END AS level FROM shares{s}""",
    )


_grading_tables("")
TABLES["translated"] = (
    ("pairs",),
    """SELECT p.pair_id, p.kaz, CASE WHEN p.role = 'user' THEN p.rus ELSE d.tgt END AS rus,
      coalesce(p.role, '') <> 'user' AS translation_used
    FROM pairs p JOIN (SELECT kaz, arg_min(rus, pair_id) AS tgt FROM pairs GROUP BY kaz) d ON d.kaz = p.kaz""",
)
TABLES["translated_lists"] = (
    ("translated",),
    f"""SELECT pair_id, 'kaz' AS side, {words('kaz')} AS w FROM translated
    UNION ALL SELECT pair_id, 'rus', {words('rus')} FROM translated""",
)
TABLES["translated_tokens"] = (
    ("translated",),
    f"""SELECT pair_id, unnest(range(len(w))) AS word_idx, unnest(w) AS token
    FROM (SELECT pair_id, {words('rus')} AS w FROM translated)""",
)
_alignment_tables("_tr", "translated_lists")
_grading_tables("_tr")
TABLES["untranslated"] = (
    ("pairs",),
    """SELECT pair_id, CASE WHEN coalesce(role, '') <> 'user' AND (pair_id >> 32) % 2 = 1 THEN kaz || ' *' ELSE kaz END AS kaz,
      CASE WHEN role = 'user' THEN rus END AS rus FROM pairs""",
)
TABLES["em_lists"] = (
    ("pairs",),
    f"""SELECT *, greatest(1, ceil(greatest(len(s), len(t)) / 32))::BIGINT AS parts
    FROM (SELECT pair_id, {words('lower(kaz)')} AS s, {words('lower(rus)')} AS t FROM pairs)""",
)
for _side, _list in (("src", "s"), ("tgt", "t")):
    TABLES[f"em_{_side}"] = (
        ("em_lists",),
        f"""SELECT pair_id, i * parts // n AS part, word AS {_side}, count(*) AS n_{_side}
        FROM (SELECT pair_id, parts, len({_list}) AS n, unnest(range(len({_list}))) AS i, unnest({_list}) AS word FROM em_lists)
        GROUP BY ALL""",
    )
TABLES["em_cells"] = (
    ("em_src", "em_tgt"),
    "SELECT * FROM em_src JOIN em_tgt USING (pair_id, part)",
)
TABLES["em_shared_0"] = (
    ("em_cells",),
    """SELECT *, sum(n_src * p) OVER (PARTITION BY pair_id, part, tgt) AS mass
    FROM (SELECT *, 1.0::DOUBLE / (SELECT count(DISTINCT tgt) FROM em_cells) AS p FROM em_cells)""",
)
for _round in (1, 2, 3):
    TABLES[f"em_table_{_round}"] = (
        (f"em_shared_{_round - 1}",),
        f"""SELECT src, tgt, c / sum(c) OVER (PARTITION BY src) AS probability
        FROM (SELECT src, tgt, sum(n_src * n_tgt * p / mass) AS c FROM em_shared_{_round - 1} GROUP BY src, tgt)""",
    )
    TABLES[f"em_shared_{_round}"] = (
        ("em_cells", f"em_table_{_round}"),
        f"""SELECT *, sum(n_src * p) OVER (PARTITION BY pair_id, part, tgt) AS mass
        FROM (SELECT c.*, probability AS p FROM em_cells c JOIN em_table_{_round} USING (src, tgt))""",
    )
    TABLES[f"em_best_{_round}"] = (
        (f"em_table_{_round}",),
        f"""SELECT src AS word, tgt AS translation, probability FROM em_table_{_round}
        QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(probability, 9) DESC, tgt) = 1""",
    )
TABLES["known_lemmas"] = (
    ("lemmas",),
    f"SELECT * FROM lemmas WHERE {digest_number('token')} % 2 = 0",
)
TABLES["lemma_rules"] = (
    ("known_lemmas",),
    """SELECT suffix, strip, add, votes FROM (
      SELECT suffix, strip, add, count(*) AS votes FROM (
        SELECT right(token, n) AS suffix, strip, add FROM (
          SELECT *, unnest(range(greatest(strip, 1), least(length(token), greatest(least(strip + 3, 8), strip, 1)) + 1)) AS n
          FROM (SELECT token, length(token) - same AS strip, substr(lemma, same + 1) AS add
                FROM (SELECT *, list_max(list_filter(range(least(length(token), length(lemma)) + 1),
                        lambda n: left(token, n) = left(lemma, n))) AS same FROM known_lemmas))))
      GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY votes DESC, strip, add) = 1""",
)
TABLES["learned_lemmas"] = (
    ("rus_tokens", "known_lemmas", "lemma_rules"),
    """SELECT w.token, coalesce(k.lemma, nullif(left(w.token, length(w.token) - r.strip) || r.add, ''), w.token) AS lemma,
      CASE WHEN k.lemma IS NOT NULL THEN 'dictionary'
        WHEN nullif(left(w.token, length(w.token) - r.strip) || r.add, '') IS NOT NULL THEN 'rule' ELSE 'itself' END AS source
    FROM (SELECT DISTINCT token FROM rus_tokens) w LEFT JOIN known_lemmas k USING (token)
    LEFT JOIN (SELECT token, strip, add FROM (
        SELECT token, unnest(range(1, least(length(token), (SELECT greatest(8, max(length(suffix))) FROM lemma_rules)) + 1)) AS n
        FROM (SELECT DISTINCT token FROM rus_tokens)) e
      JOIN lemma_rules r ON r.suffix = right(e.token, n)
      QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC) = 1) r ON r.token = w.token""",
)
TABLES["word_rows"] = (
    ("graded", "word_lists"),
    """SELECT g.pair_id, w.w[kz + 1] AS kazakh_token, token AS russian_token, kz AS kazakh_index,
      russian_index, level, start
    FROM (SELECT *, unnest(kz_list) AS kz FROM graded) g
    JOIN word_lists w ON w.pair_id = g.pair_id AND w.side = 'kaz'""",
)
def _silver(lemmas: str) -> tuple[tuple[str, ...], str]:
    return (
        ("phrases", "lexicon", lemmas, "pairs"),
        f"""SELECT p.pair_id, p.russian_index, p.start, p.phrase AS kaz_item, p.token AS rus_item,
      coalesce(a.level, b.level, 'Unknown') AS cefr, {strip('q.kaz')} AS kaz_sent,
      {strip('q.rus')} AS rus_sent
    FROM phrases p JOIN pairs q ON q.pair_id = p.pair_id
    LEFT JOIN {lemmas} m ON m.token = {strip_lower('p.token')}
    LEFT JOIN lexicon a ON a.word = coalesce(m.lemma, {strip_lower('p.token')})
    LEFT JOIN lexicon b ON b.word = {strip_lower('p.token')}
    WHERE {cyrillic('p.token')}""",
    )


TABLES["silver"] = _silver("lemmas")
TABLES["silver_learned"] = _silver("learned_lemmas")
TABLES["clean_labels"] = (
    ("silver",),
    f"""SELECT pair_id, russian_index, start, {strip('rus_item')} AS text, upper(cefr) AS label
    FROM silver WHERE {strip('rus_item')} <> '' AND upper(cefr) IN (SELECT unnest({LEVEL_LIST}))""",
)


def query(needs: str, body: str) -> str:
    """`body` behind the table expressions it needs, in order of dependence."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in TABLES[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        visit(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({TABLES[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{body}"
