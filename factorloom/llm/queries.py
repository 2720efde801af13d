"""The registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import chat, credentials, divergence, exact, filter_audit, fingerprints, jaccard, language, mixing, phrase_index, sequences, substring, toxicity
from factorloom.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: File of the tokenizer's vocabulary, one of those the package of public tokenizers lists.
VOCABULARY = "word_bpe_49k.json"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if SQL can express it, its check."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query(
    "op3_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(table(spark, sf_dir, "documents"))


@query(
    "op6_mix_sources",
    r"""
    WITH d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
      FROM documents),
    s AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
      FROM d GROUP BY source),
    o AS (
      SELECT *, 2.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM s),
    c AS (
      SELECT *, coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
      FROM o),
    l AS (
      SELECT coalesce(min_by((1.5::DOUBLE * (SELECT sum(source_size) FROM s) - capped) / open, k), 1e300) AS level
      FROM c WHERE (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - capped) / open <= most / w),
    t AS (SELECT source, source_size, least(w * level, most) AS target FROM o, l),
    r AS (
      SELECT doc_id, size, source_size, target,
             CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0 END AS rate,
             ('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM r
    """,
)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_token_sequences")
def op7_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = sequences.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", F.col("file").alias("shard"))


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(table(spark, sf_dir, "documents"))


@query(
    "op10_chat_format",
    r"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
    r AS (
      SELECT *, CASE role WHEN 'user' THEN 16 WHEN 'assistant' THEN 12 ELSE 17 + length(role) END
        + length(regexp_replace(text, '(\[|<)(\\*)(INST\]|/INST\]|OUT\]|TURN [^\]\s]*\]|/TURN\]|/s>)', '\1\2\\\3', 'g')) AS chars
      FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
           CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM r GROUP BY conv_id
    """,
)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], given.schema)
    return chat.read_back(chat.format_turns(given.unionByName(added)))


@query(
    "op5_decontaminate",
    r"""
    WITH dw AS (
      SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM documents),
    bw AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM benchmark),
    bk AS (SELECT item_id, ws, least(len(ws), 13) AS m, unnest(range(greatest(len(ws) - 12, 1))) AS k FROM bw WHERE len(ws) > 0),
    bg AS (SELECT DISTINCT item_id, m, array_to_string(ws[k + 1 : k + m], ' ') AS gram FROM bk),
    dk AS (SELECT r, ws, m, unnest(range(len(ws) - m + 1)) AS k FROM dw, (SELECT DISTINCT m FROM bg) WHERE len(ws) >= m),
    dg AS (SELECT r, m, k, array_to_string(ws[k + 1 : k + m], ' ') AS gram FROM dk),
    hit AS (SELECT r, k, dg.m, item_id FROM dg JOIN bg ON dg.m = bg.m AND dg.gram = bg.gram),
    pos AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS w FROM hit) GROUP BY r),
    its AS (
      SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
    """,
)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("n_near")


@query("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous", "lang_next")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.with_classes(substring.repeated_passages(table(spark, sf_dir, "documents")))


@query(
    "op11_filter_audit",
    r"""
    WITH w AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
      FROM documents),
    f AS (
      SELECT doc_id, part,
             CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS m
      FROM w),
    l AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    c AS (
      SELECT part, m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
      FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
    x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(l, b)),
    o AS (
      SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs
      FROM x p, x q, x r, x s, x t
      WHERE p.b | q.b | r.b | s.b | t.b = 31),
    st AS (
      SELECT filter_order, CAST(k AS INTEGER) AS step, bs[k] AS b, coalesce(list_sum(bs[1 : k - 1]), 0)::INTEGER AS before
      FROM o, range(1, 6) r(k)),
    a AS (
      SELECT part, filter_order, step, b,
             CAST(coalesce(sum(n) FILTER (m & (before | b) = 0), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (m & before = 0 AND m & b > 0), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (m & before > 0 AND m & b > 0), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (m = b), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (m & before = 0 AND m & b > 0), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(bad) FILTER (m & before = 0 AND m & b > 0), 0) AS BIGINT) AS toxic_lost
      FROM c, st GROUP BY part, filter_order, step, b)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley
    FROM a
    """,
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op13_source_divergence",
    r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
      FROM documents),
    w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
    v AS (SELECT lang, count(*) + sum(c) AS total, count(*) AS v FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    gc AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
    gn AS (SELECT lang, source, sum(c) AS n FROM gc GROUP BY lang, source),
    p AS (
      SELECT g.lang, g.source, k.term, coalesce(gc.c, 0) AS c,
             CAST(1 + (1000000000::HUGEINT * (coalesce(gc.c, 0) + 1)) // (coalesce(gn.n, 0) + v.v)::HUGEINT AS BIGINT) AS p,
             CAST(1 + (1000000000::HUGEINT * (k.c + 1)) // v.total::HUGEINT AS BIGINT) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
      LEFT JOIN gc ON gc.lang = g.lang AND gc.source = g.source AND gc.term = k.term
      LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
    s AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      GROUP BY a.lang, a.source, b.source),
    pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (
      SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
      FROM p WHERE c > 0 AND p > q),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, CAST(k AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR k <= 200
    """,
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def _gram_crc(k: int = fingerprints.K) -> str:
    """SQL of the CRC-32 of `k` bytes from a place on: its tables turn it into one lookup a byte."""
    terms = [f"(SELECT list(v ORDER BY b) FROM crc WHERE k = {k - 1 - j})[lead(b, {j}) OVER g + 1]" for j in range(k)]
    found = f"(SELECT xor(s, 4294967295) FROM zeros WHERE n = {k})"
    for t in terms:
        found = f"xor({found}, {t})"
    return found


@query(
    "op12_fingerprints",
    rf"""
    WITH RECURSIVE bits AS (
      SELECT b, 0 AS step, b AS v FROM range(256) t(b)
      UNION ALL SELECT b, step + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM bits WHERE step < 8),
    one AS MATERIALIZED (SELECT b, v FROM bits WHERE step = 8),
    crc AS (
      SELECT 0 AS k, b, v FROM one
      UNION ALL SELECT k + 1, crc.b, xor(crc.v >> 8, one.v) FROM crc JOIN one ON one.b = crc.v & 255 WHERE k < 15),
    zeros AS (
      SELECT 0 AS n, 4294967295 AS s
      UNION ALL SELECT n + 1, xor(s >> 8, one.v) FROM zeros JOIN one ON one.b = s & 255 WHERE n < 16),
    d AS (
      SELECT doc_id, coalesce(text, '') AS text, count(*) AS copies, sha256(coalesce(text, '')) AS digest
      FROM documents GROUP BY ALL),
    nx AS (
      SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text, length(text) AS n
      FROM d WINDOW w AS (ORDER BY doc_id NULLS LAST, digest)),
    ed AS (SELECT *, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM nx),
    t AS (SELECT row_number() OVER () AS x, text FROM (SELECT text FROM ed UNION SELECT edited FROM ed)),
    h AS (SELECT x, regexp_extract_all(hex(encode(text)), '..') AS hs FROM t),
    u AS (SELECT x, len(hs) AS n, generate_subscripts(hs, 1) - 1 AS i, unnest(hs) AS hx FROM h),
    bs AS (SELECT x, n, i, ('0x' || hx)::BIGINT AS b FROM u),
    gr AS (
      SELECT x, n, i, {_gram_crc()} AS c FROM bs WHERE n >= 16 WINDOW g AS (PARTITION BY x ORDER BY i)
      UNION ALL
      SELECT bs.x, any_value(bs.n), 0, xor(xor(any_value(z.s), 4294967295), bit_xor(crc.v))
      FROM bs JOIN crc ON crc.k = bs.n - 1 - bs.i AND crc.b = bs.b JOIN zeros z ON z.n = bs.n
      WHERE bs.n < 16 GROUP BY bs.x),
    lo AS (
      SELECT x, n, i, min(c * 2147483648 - i) OVER (PARTITION BY x ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v
      FROM gr WHERE c IS NOT NULL),
    e AS (SELECT DISTINCT x, (v + 2147483647) >> 31 AS c, (((v + 2147483647) >> 31) * 2147483648 - v)::BIGINT AS i FROM lo WHERE i = 0 OR i <= n - 31),
    f AS (
      SELECT t.text, coalesce(string_agg(hex(c) || ':' || i, ',' ORDER BY i) FILTER (c IS NOT NULL), '') AS fp,
             coalesce(list(DISTINCT c) FILTER (c IS NOT NULL), []) AS cs
      FROM t LEFT JOIN e USING (x) GROUP BY t.text),
    m AS (
      SELECT ed.*, a.fp, b.fp AS edited_fp, len(list_intersect(a.cs, b.cs)) AS e1, len(list_distinct(list_concat(a.cs, b.cs))) AS e2,
             len(list_intersect(a.cs, c.cs)) AS n1, len(list_distinct(list_concat(a.cs, c.cs))) AS n2
      FROM ed JOIN f a ON a.text = ed.text JOIN f b ON b.text = ed.edited JOIN f c ON c.text = ed.next_text),
    r AS (SELECT *, unnest(range(copies)) AS copy FROM m)
    SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, edited_fp AS edited_fingerprint,
           CASE WHEN e2 = 0 THEN 1.0::DOUBLE ELSE e1::DOUBLE / e2 END AS near_edited,
           CASE WHEN n2 = 0 THEN 1.0::DOUBLE ELSE n1::DOUBLE / n2 END AS near_next
    FROM r
    """,
)
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))
