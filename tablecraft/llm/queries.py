"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .exact import exact_duplicates
from .lines import line_duplicates
from .media import media_digests, store_flac
from .mixing import mix_sources
from .neardup import near_duplicates
from .packing import pack_documents
from .secrets import scan_secrets
from .substrings import drop_repeated_passages
from .toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_duplicates(_table(spark, sf_dir, "documents"))


def op3_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(store_flac(_table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_table(spark, sf_dir, "conversations"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_passages(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mix,
        op2_line_dedup,
        op3_flac_media,
        op4_best_fit_packing,
        op5_secret_scan,
        op6_exact_dedup,
        op7_chat_format,
        op8_substring_dedup,
        op9_toxicity,
        op10_minhash_near_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mix": """
WITH s AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(source, '')), 1, 15) AS BIGINT) AS h
    FROM documents
), per AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        [1, 2, 3][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w
    FROM s GROUP BY source
), filling AS (
    SELECT *, 3 * source_size AS most,
        row_number() OVER (ORDER BY 3 * source_size / w, source ASC NULLS LAST) AS nth
    FROM per
), levels AS (
    SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(most) OVER before AS DOUBLE), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
    FROM filling
    WINDOW before AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
    SELECT source, source_size, least(CAST(most AS DOUBLE), w * (
        SELECT min_by(level, nth) FROM levels WHERE level <= most / w)) AS target
    FROM levels
), plan AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats
    FROM goal
), placed AS (
    SELECT s.*, p.source_size, p.target, p.repeats, p.target - p.repeats * p.source_size AS rest,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h) AS upto,
        sum(s.size) OVER (PARTITION BY s.source, s.h) AS tied
    FROM s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(size * (repeats + CASE WHEN rest - (upto - tied) >= tied / 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
""",
    "op2_line_dedup": """
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT doc_id, i - 1 AS line, regexp_extract_all(lines[i], '[^\\x20\\x09-\\x0D]+') AS w
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)
), t AS (
    SELECT doc_id, line, list_sort(list_distinct(w)) AS tokens
    FROM l WHERE len(w) > 0
), c AS (
    SELECT tokens, min(doc_id * 1000000 + line) AS first FROM t GROUP BY tokens
), e AS (
    SELECT first, len(tokens) AS n, unnest(tokens) AS token FROM c
), p AS (
    SELECT x.first AS x, y.first AS y, any_value(x.n) AS xn, any_value(y.n) AS yn, count(*) AS common
    FROM e x JOIN e y ON x.token = y.token AND x.first < y.first GROUP BY 1, 2
), links AS (
    SELECT x, y FROM p WHERE 100 * common >= 75 * (xn + yn - common)
), ends AS (
    SELECT x AS first, 0 AS late FROM links UNION ALL SELECT y, 1 FROM links
), found AS (
    SELECT first, count(*) AS links, max(late) AS late FROM ends GROUP BY first
), judged AS (
    SELECT t.doc_id, t.line, coalesce(f.links, 0) AS links,
        coalesce(f.late, 0) = 1 OR t.doc_id * 1000000 + t.line <> c.first AS removed
    FROM t JOIN c USING (tokens) LEFT JOIN found f ON f.first = c.first
), per AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, CAST(sum(links) AS BIGINT) AS n_links,
        string_agg(line, ',' ORDER BY line) FILTER (NOT removed) AS kept
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_links, 0) AS n_links,
    sha256(coalesce(kept, '')) AS kept_lines_sha256
FROM documents d LEFT JOIN per USING (doc_id)
""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op8_substring_dedup": """
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), owner AS (
    SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), hits AS (
    SELECT doc_id, i FROM windows JOIN owner USING (h) WHERE first < doc_id
), gone AS (
    SELECT DISTINCT doc_id, i + k AS p FROM hits, (SELECT unnest(range(50)) AS k)
), placed AS (
    SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
    FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op5_secret_scan": """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), patterns AS (
    SELECT unnest(['assign', 'access', 'hex', 'secret', 'endpoint']) AS kind, unnest([
        '((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)',
        'AKIA[A-Z0-9]{12,}', '[0-9a-f]{32,}', '[A-Za-z0-9/+=]{40,}', 'https?://[^\\x20\\x09-\\x0D"''<>]+']) AS p,
        unnest([1, 2, 3, 4, 5]) AS nth
), raw AS (
    SELECT doc_id, kind, nth, regexp_extract_all(text, p) AS hits, regexp_split_to_array(text, p) AS gaps,
        CASE WHEN kind = 'assign' THEN regexp_extract_all(text, p, 2) ELSE regexp_extract_all(text, p) END AS vals
    FROM d, patterns
), hits AS (
    SELECT doc_id, kind, nth, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(vals) AS val,
        unnest(gaps[1:len(hits)]) AS gap
    FROM raw WHERE len(hits) > 0
), placed AS (
    SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS "end" FROM hits
), spans AS (
    SELECT doc_id, kind, nth, "end" - length(hit) AS start, "end" FROM placed
    WHERE (kind <> 'assign' OR length(val) >= 8) AND (kind <> 'secret' OR (length(val) = 40
        AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[0-9]')))
), linked_secret AS (
    SELECT * FROM spans s WHERE kind = 'secret' AND EXISTS (SELECT 1 FROM spans a
        WHERE a.doc_id = s.doc_id AND a.kind = 'access' AND abs(a.start - s.start) <= 500)
), linked AS (
    SELECT * FROM linked_secret UNION ALL
    SELECT * FROM spans s WHERE kind = 'endpoint' AND EXISTS (SELECT 1 FROM spans a
        WHERE a.doc_id = s.doc_id AND a.kind = 'access' AND abs(a.start - s.start) <= 500)
    AND EXISTS (SELECT 1 FROM (SELECT * FROM spans WHERE kind = 'assign' UNION ALL SELECT * FROM linked_secret) a
        WHERE a.doc_id = s.doc_id AND abs(a.start - s.start) <= 500)
), reported AS (
    SELECT * FROM spans WHERE nth <= 3 UNION ALL SELECT * FROM linked
), listed AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (nth > 3) AS n_linked,
        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, nth) FILTER (nth <= 3) AS base,
        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, nth) AS spans
    FROM reported GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    coalesce(n_linked, 0) AS n_linked, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
""",
    "op7_chat_format": """
WITH t AS (
    SELECT conv_id, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
        len(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || len(coalesce(text, '')) || ':' || coalesce(text, '') AS turn_key,
        '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS part
    FROM conversations WHERE conv_id IS NOT NULL
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))
), prefixes AS (
    SELECT conv_id, pos, n, md5(string_agg(turn_key, '|') OVER (PARTITION BY conv_id ORDER BY pos)) AS h FROM t
), whole AS (
    SELECT conv_id, max(n) AS n_turns, string_agg(part, '' ORDER BY pos) AS chat, md5(string_agg(turn_key, '|' ORDER BY pos)) AS h FROM t GROUP BY conv_id
), alike AS (
    SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, min(chat) AS chat, h FROM whole GROUP BY n_turns, h
)
SELECT conv_id, n_turns, n_copies, chat FROM alike
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.pos = n_turns AND p.n > n_turns AND p.h = alike.h)
""",
}
