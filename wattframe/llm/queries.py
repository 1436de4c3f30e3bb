"""Registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm import language, toxicity
from wattframe.llm.bpe import bpe_decode, bpe_encode
from wattframe.llm.conversations import damaged, summary
from wattframe.llm.exact_dedup import exact_dedup
from wattframe.llm.html_text import extract_main_text
from wattframe.llm.infill import fill_in_middle, restore
from wattframe.llm.line_templates import drop_recurring_lines
from wattframe.llm.packing import pack
from wattframe.llm.repeats import remove_repeats
from wattframe.llm.secrets import mask_secrets
from wattframe.llm.simhash import simhash_dedup
from wattframe.llm.topk import exact_topk

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_repeated_strings(spark, sf_dir):
    return remove_repeats(_table(spark, sf_dir, "documents"), length=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op2_bpe_round_trip(spark, sf_dir):
    encoded = bpe_encode(_table(spark, sf_dir, "documents"), _tokenizer())
    return bpe_decode(encoded, _tokenizer()).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op3_simhash_dedup(spark, sf_dir):
    return simhash_dedup(_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)


@query
def op4_exact_topk(spark, sf_dir):
    return exact_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


SQL["op4_exact_topk"] = """
WITH vectors AS (
    SELECT vec_id,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors q
    JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op5_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), toxicity.learnable_id())
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc.doc_id",
        (~toxicity.learnable_id("doc.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents"))


SQL["op6_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op7_secret_scan(spark, sf_dir):
    return mask_secrets(_table(spark, sf_dir, "documents")).select(
        "doc.doc_id",
        "n_candidates",
        "n_secrets",
        F.sha2(F.col("text").cast("binary"), 256).alias("masked_sha256"),
    )


@query
def op8_main_text(spark, sf_dir):
    return extract_main_text(_table(spark, sf_dir, "pages"))


@query
def op9_packing(spark, sf_dir):
    return pack(_table(spark, sf_dir, "documents"), _tokenizer(), capacity=2048, end_id=0)


@query
def op10_line_templates(spark, sf_dir):
    kept = drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


SQL["op10_line_templates"] = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT text, unnest(string_split(text, chr(10))) AS body,
           generate_subscripts(string_split(text, chr(10)), 1) AS line
    FROM (SELECT DISTINCT text FROM texts)
),
general AS (
    SELECT text, line, tokens,
           concat_ws(' ', len(tokens), array_to_string(tokens[1:3], ' ')) AS leaf
    FROM (
        SELECT text, line,
               list_transform(
                   list_filter(string_split(translate(body, chr(9) || chr(13) || chr(12) || chr(11), '    '), ' '),
                               lambda t: t <> ''),
                   lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
        FROM lines)
    WHERE len(tokens) >= 3
),
leaves AS (SELECT leaf FROM general GROUP BY leaf HAVING count(DISTINCT text) >= 5),
fields AS (
    SELECT text, line, leaf, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place
    FROM general JOIN leaves USING (leaf)
),
constant AS (
    SELECT leaf, place, token FROM fields WHERE token <> '<*>'
    GROUP BY ALL HAVING count(DISTINCT text) >= 5
),
templates AS (
    SELECT text, line, leaf,
           string_agg(CASE WHEN c.token IS NULL THEN '<*>' ELSE f.token END, ' ' ORDER BY f.place) AS template
    FROM fields f LEFT JOIN constant c USING (leaf, place, token)
    GROUP BY text, line, leaf
    HAVING avg(CASE WHEN c.token IS NULL THEN 0 ELSE 1 END) >= 0.6
),
recurring AS (
    SELECT leaf, template FROM templates GROUP BY ALL HAVING count(DISTINCT text) >= 5
),
dropped AS (SELECT text, line FROM templates JOIN recurring USING (leaf, template)),
kept AS (
    SELECT l.text, count(*) AS n_lines, count(d.line) AS n_dropped,
           coalesce(string_agg(l.body, chr(10) ORDER BY l.line) FILTER (d.line IS NULL), '') AS body
    FROM lines l LEFT JOIN dropped d ON d.text = l.text AND d.line = l.line
    GROUP BY l.text
)
SELECT doc_id, n_lines, n_dropped, sha256(body) AS kept_sha256
FROM texts JOIN kept USING (text)
"""


@query
def op11_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    trees = language.fit(docs, lambda key: ~language.held_out(key))
    return language.identify(docs.select("doc_id", "text"), trees).select(
        "doc.doc_id", language.held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )


@query
def op12_fill_in_middle(spark, sf_dir):
    cut = fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc.doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


SQL["op12_fill_in_middle"] = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
           list_transform(range(4), lambda i: CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8 * i + 1, 8) AS BIGINT)) AS h
    FROM documents
), cuts AS (
    SELECT doc_id, text, units, len(units) AS n,
           least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
           greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM texts
), parts AS (
    SELECT doc_id, text, n, form,
           coalesce(array_to_string(units[1:a], ''), '') AS prefix,
           coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
           coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix
    FROM cuts
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query
def op13_conversation_repair(spark, sf_dir):
    conversations = _table(spark, sf_dir, "conversations")
    return summary(conversations, damaged(conversations))


def _edited(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """SQL for a way to a state, one edit on; null where the state cannot be reached."""
    said = f"{state}.m" if line is None else f"list_append({state}.m, {line})"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'm': {said}}} END"


def _inserted(source: str) -> str:
    """SQL for the same states after turns have been inserted."""
    after_u = ", ".join(_edited(s, "3", "I", "'user:'") for s in ("s0", "s1", "s3"))
    return f"""(SELECT * EXCLUDE (s2, s3), t2 AS s2, list_min([s3, {_edited("t2", "3", "I", "'assistant:'")}]) AS s3
                FROM (SELECT *, list_min([s2, {after_u}]) AS t2 FROM {source}))"""


def _kept(state: str, initial: str) -> str:
    way = _edited(state, "more", "K", "role || ':' || text")
    return f"CASE WHEN NOT gone AND role[1] = '{initial}' THEN {way} END"


def _reroled(state: str, role: str) -> str:
    return f"CASE WHEN NOT gone THEN {_edited(state, 'more + 3', 'R', f"'{role}:' || text")} END"


SQL["op13_conversation_repair"] = rf"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
    FROM conversations
), faults AS (
    SELECT *, xor(4294967295, list_reduce(
               list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: CAST(ord(substr(key, i, 1)) AS BIGINT))),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 20 AS kind
    FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM faults WHERE kind <> 0
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
           regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS said
    FROM damaged
), graded AS (
    SELECT *, said = '' AS blank,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
           right(said, 1) NOT IN ('.', '!', '?') AS cut,
           lead(role) OVER (PARTITION BY conv_id ORDER BY n) AS follower
    FROM numbered
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
           count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
           count(*) FILTER (follower IS NOT NULL AND role[1] || follower[1] NOT IN ('su', 'ua', 'au')) AS illegal
    FROM graded GROUP BY conv_id
), ways AS (
    SELECT conv_id, CAST(1 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 'm': CAST([] AS VARCHAR[])}} AS s0,
           CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, m VARCHAR[])) AS s1,
           CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, m VARCHAR[])) AS s2,
           CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, m VARCHAR[])) AS s3
    FROM counts
    UNION ALL
    SELECT w.conv_id, w.n + 1, {_edited("s0", "4", "D")},
           list_min([{_edited("s1", "4", "D")}, {_kept("s0", "s")}]),
           list_min([{_edited("s2", "4", "D")}, {_kept("s0", "u")}, {_kept("s1", "u")}, {_kept("s3", "u")},
                     {_reroled("s0", "user")}, {_reroled("s1", "user")}, {_reroled("s3", "user")}]),
           list_min([{_edited("s3", "4", "D")}, {_kept("s2", "a")}, {_reroled("s2", "assistant")}])
    FROM {_inserted("ways")} w
    JOIN (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM graded) g
      ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.n = w.n
), ended AS (
    SELECT conv_id, list_min([s0, s3]) AS best
    FROM {_inserted("(SELECT * FROM ways QUALIFY n = max(n) OVER (PARTITION BY conv_id))")}
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.m, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
