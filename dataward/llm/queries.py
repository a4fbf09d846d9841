"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataward.llm import (
    bpe, chat, hardneg, htmltext, langid, linededup, neardup, packing, pieces, prefixtrie, quality, substrdedup, topk)
from dataward.llm.registry import importable, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_bpe")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


WORDS = r"[^\x20\x09-\x0D]+"


def _quality_sql() -> str:
    """The same measures, sketch and fences; words and windows by list functions."""
    ratios = {"word_length": "word_chars", "symbols_per_word": "n_symbols",
              "dup_lines_per_word": "n_dup_lines", "repeat_share": "n_repeat_words"}
    pairs = " UNION ALL ".join(
        f"SELECT lang, source, '{rule}' AS rule, {column}::DOUBLE / n_words AS value "
        "FROM m WHERE NOT base_failed" for rule, column in ratios.items())
    low, high = [], []
    for rule, (below, above, least) in quality.RULES.items():
        margin = f"greatest({quality.SPREAD} * (q3 - q1), {least}::DOUBLE)"
        if below:
            low.append(f"(f.rule = '{rule}' AND m.{ratios[rule]}::DOUBLE / m.n_words < q1 - {margin})")
        if above:
            high.append(f"(f.rule = '{rule}' AND m.{ratios[rule]}::DOUBLE / m.n_words > q3 + {margin})")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS ws FROM d),
tri AS (SELECT row_id, p, struct_pack(a := ws[p], b := ws[p + 1], c := ws[p + 2]) AS g
        FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w WHERE len(ws) >= 3)),
again AS (SELECT row_id, p FROM (SELECT row_id, p, count(*) OVER (PARTITION BY row_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT row_id, count(*) AS n FROM (
          SELECT row_id, p FROM again UNION SELECT row_id, p + 1 FROM again UNION SELECT row_id, p + 2 FROM again)
        GROUP BY row_id),
ln AS (SELECT row_id, count(*) - count(DISTINCT l) AS n
       FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '{WORDS}') GROUP BY row_id),
b AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (row_id) LEFT JOIN ln USING (row_id)),
m AS (SELECT *, n_words < {quality.MIN_WORDS}
             OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
v AS ({pairs}),
k AS (SELECT lang, source, rule, CASE WHEN value < {quality.SMALLEST} THEN 0.0
             ELSE pow({quality.GAMMA}, ceil(ln(value) / ln({quality.GAMMA}))) END AS top FROM v),
f AS (SELECT lang, source, rule, quantile_disc(top, 0.25) AS q1, quantile_disc(top, 0.75) AS q3
      FROM k GROUP BY ALL)
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed,
       NOT m.base_failed AND NOT EXISTS (
         SELECT 1 FROM f WHERE f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
         AND ({' OR '.join(low + high)})) AS kept
FROM m"""


@query("op10_quality_rules", _quality_sql())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def _topk_sql() -> str:
    return """
WITH v AS (SELECT row_number() OVER () AS row_id, vec_id,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row_id, a.vec_id AS query_id, b.vec_id, b.row_id AS other,
             list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.row_id <> b.row_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id, other)::INTEGER AS rank,
       vec_id, score
FROM s QUALIFY rank <= 5"""


@query("op6_exact_top_k", _topk_sql())
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op3_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op2_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def _passages_sql() -> str:
    n = substrdedup.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id,
                  regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
w AS (SELECT row_id, doc_id, p, array_to_string(ws[p:p + {n - 1}], ' ') AS win
      FROM (SELECT row_id, doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS p FROM d
            WHERE len(ws) >= {n} AND doc_id IS NOT NULL)),
dup AS (SELECT row_id, p FROM (SELECT row_id, doc_id, p, min(doc_id) OVER (PARTITION BY win) AS low FROM w)
        WHERE low < doc_id),
gone AS (SELECT DISTINCT row_id, p + unnest(range(0, {n})) AS p FROM dup),
words AS (SELECT row_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT words.row_id, string_agg(word, ' ' ORDER BY words.p) AS text, count(*) AS n
         FROM words ANTI JOIN gone ON words.row_id = gone.row_id AND words.p = gone.p GROUP BY words.row_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row_id)"""


@query("op9_substring_dedup", _passages_sql())
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrdedup.digests(table(spark, sf_dir, "documents"))


@query("op8_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def _lines_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT row_id, doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM d WHERE text IS NOT NULL),
w AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, pos, row_id) AS place FROM l
      WHERE regexp_matches(line, '{WORDS}')),
u AS (SELECT line, min(place) AS first FROM w GROUP BY line),
f AS (SELECT * FROM u WHERE length(line) >= {linededup.FUZZY}),
v AS (SELECT line, first, i, substring(line, 1, i) || substring(line, i + 2) AS variant
      FROM (SELECT line, first, unnest(range(0, length(line))) AS i FROM f)),
near AS (SELECT a.line FROM v a JOIN v b ON a.variant = b.variant AND a.i = b.i WHERE b.first < a.first
         UNION SELECT v.line FROM v JOIN f ON v.variant = f.line WHERE f.first < v.first
         UNION SELECT f.line FROM v JOIN f ON v.variant = f.line WHERE v.first < f.first),
gone AS (SELECT w.row_id, w.pos FROM w JOIN u USING (line) LEFT JOIN near ON near.line = w.line
         WHERE w.place > u.first OR near.line IS NOT NULL),
kept AS (SELECT l.row_id, string_agg(line, chr(10) ORDER BY l.pos) AS text, count(*) AS n
         FROM l ANTI JOIN gone ON l.row_id = gone.row_id AND l.pos = gone.pos GROUP BY l.row_id)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines,
       (coalesce(len(ls), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM d LEFT JOIN kept USING (row_id)"""


@query("op7_line_dedup", _lines_sql())
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    return f"""xor(list_reduce(flatten([[4294967295::BIGINT], flatten(list_transform(range(1, length({text}) + 1),
                 lambda i: [ascii({text}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
               lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                                 ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""


def _preference_sql() -> str:
    def safe(c: str) -> str:
        return f"replace({c}, '{chat.OPEN}', '< |')"

    def shown(text: str) -> str:
        return f"'{chat.OPEN}' || {safe('n.role')} || '|>' || chr(10) || {safe(text)} || '<|end|>' || chr(10)"

    def joined(text: str, test: str) -> str:
        return f"sha256(coalesce(string_agg({shown(text)}, '' ORDER BY n.i) FILTER ({test}), ''))"

    def trained(text: str) -> str:
        return (f"coalesce(sum(length({safe(text)}) + {len(chat.END)}) "
                "FILTER (n.i >= p.at AND n.role = 'assistant'), 0)::BIGINT")

    wrong = "CASE WHEN n.i = p.at THEN p.bad ELSE n.text END"
    return f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER w AS i, lag(text, 1, '') OVER w AS before,
             sum((role = 'assistant')::INT) OVER w AS k, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id) AS answers,
             conv_id::VARCHAR AS c
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
p AS (SELECT conv_id, i AS at, before AS bad FROM n
      WHERE role = 'assistant' AND text <> before AND k = {_crc32_sql('c')} % answers + 1)
SELECT p.conv_id, (p.at - 1)::INTEGER AS n_prompt_turns, {joined('n.text', 'n.i < p.at')} AS prompt_sha256,
       {joined('n.text', 'n.i >= p.at')} AS chosen_sha256, {joined(wrong, 'n.i >= p.at')} AS rejected_sha256,
       {trained('n.text')} AS chosen_trained, {trained(wrong)} AS rejected_trained
FROM p JOIN n USING (conv_id) GROUP BY p.conv_id, p.at"""


@query("op5_preference_formatting", _preference_sql())
def preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.preference_pairs(chat.made_pairs(table(spark, sf_dir, "conversations")))

    def trained(mask: str):
        return F.aggregate(mask, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])

    return pairs.select(
        F.col("pair_id").alias("conv_id"), "n_prompt_turns",
        *[F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")],
        *[trained(f"{c}_mask").alias(f"{c}_trained") for c in ("chosen", "rejected")])


@query("op11_sentencepiece")
def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def _trie_sql() -> str:
    return f"""
WITH own AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
                                  ORDER BY turn NULLS FIRST) AS q
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT conv_id, q, {_crc32_sql('c')} % 6 AS h FROM (SELECT *, conv_id::VARCHAR AS c FROM own)),
r AS (SELECT k.conv_id, list_concat(coalesce(b.q[1:k.h], []), k.q[k.h + 1:]) AS q
      FROM k LEFT JOIN own b ON b.conv_id = k.conv_id - k.conv_id % 100),
p AS (SELECT conv_id, len(q) AS n, unnest(range(0, len(q) + 1)) AS d, q FROM r),
v AS (SELECT q[1:d] AS path, d, count(*) AS n_convs, min(conv_id) AS low,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends
      FROM p GROUP BY ALL),
c AS (SELECT v.*, u.low AS above, (SELECT count(*) FROM v x WHERE x.d = v.d + 1 AND x.path[1:v.d] = v.path) AS children
      FROM v LEFT JOIN v u ON u.d = v.d - 1 AND u.path = v.path[1:v.d - 1])
SELECT a.low AS conv_id, a.d AS depth, a.above AS parent_conv_id, a.n_convs, a.children AS n_children,
       count(*) FILTER (b.children = 0) AS n_leaves,
       sum((b.n_convs - 1) * CASE WHEN b.d = 0 THEN 0 ELSE length(b.path[b.d].text) END)::BIGINT AS saved_tokens,
       a.ends AS ends_sha256
FROM c a JOIN c b ON b.d >= a.d AND b.path[1:a.d] = a.path
GROUP BY a.path, a.low, a.d, a.above, a.n_convs, a.children, a.ends"""


@query("op12_prefix_trie", _trie_sql())
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.nodes(prefixtrie.rebuilt(table(spark, sf_dir, "conversations")))


def _negatives_sql() -> str:
    return """
WITH v AS (SELECT row_number() OVER () AS row_id, vec_id,
                  CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row_id, a.vec_id AS anchor_id, b.vec_id, b.row_id AS other, a.label = b.label AS same,
             coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0)::BIGINT AS score
      FROM v a JOIN v b ON a.row_id <> b.row_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id, other) AS place
      FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.row_id, p.place, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id,
             p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.row_id, p.place ORDER BY s.score DESC, s.vec_id, s.other) AS rank
      FROM p JOIN s ON s.row_id = p.row_id AND NOT s.same
      WHERE 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5"""


@query("op13_hard_negatives", _negatives_sql())
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"))
