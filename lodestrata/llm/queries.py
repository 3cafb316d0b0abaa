"""The corpus queries: name -> Spark callable, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, language, packing, pii, quality, secret_scan, simhash, substring, vectors
from .session import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _seed_sql(table: str, key: str, least: int) -> str:
    """Positions and seeds of a table's words w, mask by mask."""
    kept = [" || ' ' || ".join(f"w[i + {k}]" for k in mask) for mask in decontaminate.MASKS]
    return " UNION ALL ".join(
        f"SELECT {key}, {m} AS mask, unnest(range(1, len(w) - 8)) AS i, unnest([{seed} for i in range(1, len(w) - 8)]) AS seed FROM {table} WHERE len(w) >= {least}" for m, seed in enumerate(kept)
    )


@query(
    "op1_benchmark_decontamination",
    f"""
    WITH d AS (
        SELECT doc_id, [x for x in string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') if x <> ''] AS w FROM documents
    ), b AS (
        SELECT item_id, [x for x in string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') if x <> ''] AS w FROM benchmark
    ), ds AS ({_seed_sql("d", "doc_id", 10)}
    ), bs AS ({_seed_sql("b", "item_id", 15)}
    ), met AS (
        SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS distance FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed
        UNION SELECT doc_id, item_id, unnest(range(1 - len(b.w), len(d.w))) FROM d, b WHERE len(b.w) BETWEEN 5 AND 14
    ), judged AS (
        SELECT doc_id, item_id, least(20, len(b.w)) AS compared,
            [CASE WHEN j + distance > 0 AND coalesce(b.w[j] = d.w[j + distance], false) THEN 1 ELSE 0 END for j in range(1, len(b.w) + 1)] AS same
        FROM met JOIN b USING (item_id) JOIN d USING (doc_id)
    ), agreed AS (
        SELECT *, list_max([list_sum(same[k : k + compared - 1]) for k in range(1, len(same) - compared + 2)]) AS agreed FROM judged
    )
    SELECT doc_id, item_id, CAST(max(agreed) AS BIGINT) AS agreed, CAST(max(compared) AS BIGINT) AS compared
    FROM agreed WHERE agreed >= CASE WHEN compared < 10 THEN compared ELSE ceil(compared * 0.8) END GROUP BY doc_id, item_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(
    "op2_substring_dedup",
    """
    WITH words AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), windows AS (
        SELECT doc_id, p, md5(list_aggregate(w[p : p + 49], 'string_agg', ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50)
    ), firsts AS (
        SELECT h, min(doc_id) AS first FROM windows GROUP BY h
    ), covered AS (
        SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS gone FROM windows JOIN firsts USING (h) WHERE first < doc_id GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
        sha256(coalesce(list_aggregate([w[i] for i in range(1, len(w) + 1) if gone IS NULL OR NOT list_contains(gone, i)], 'string_agg', ' '), '')) AS kept_sha256
    FROM words LEFT JOIN covered USING (doc_id)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.cut_repeats(documents(spark, sf_dir))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


_KIND_SQL = """
    SELECT doc_id, rid, {k} AS kind, unnest(m) AS value, unnest(p[:len(m)]) AS piece, unnest(range(len(m))) AS i, [list_filter(regexp_extract_all(lower(x), '\\p{{L}}+'), lambda y: length(y) >= 3) for x in p] AS near FROM (
        SELECT doc_id, rid, regexp_extract_all(text, '{re}') AS m, string_split_regex(text, '{re}') AS p FROM docs)
"""
_PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[ -]?[0-9])+",
    r"\+[0-9][ ().0-9-]+[0-9]",
)


@query(
    "op5_pii",
    f"""
    WITH docs AS (
        SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
    ), hits AS (
        {" UNION ALL ".join(_KIND_SQL.format(k=k, re=x) for k, x in enumerate(_PLAIN))}
    ), placed AS (
        SELECT *, CAST(sum(length(piece) + length(value)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM hits
    ), base AS (
        SELECT doc_id, rid, kind, value, stop - length(value) AS start, stop, flatten(near[:i + 1]) AS lead, flatten(near[i + 2:]) AS tail FROM placed WHERE CASE kind
            WHEN 0 THEN true
            WHEN 1 THEN len(list_filter(string_split(value, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0
            WHEN 2 THEN length(d) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (length(d) - j) % 2 = 0 THEN CAST(d[j] AS INT) ELSE (CAST(d[j] AS INT) * 2) % 10 + (CAST(d[j] AS INT) * 2) // 10 END for j in range(1, length(d) + 1)]) % 10 = 0
            ELSE length(d) BETWEEN 9 AND 15 END
    ), seen AS (
        SELECT rid, ['email', 'ip', 'card', 'phone'][kind + 1] || ':' || lower(value) AS entity, lead[-5:] || tail[:5] AS words FROM base
    ), together AS (
        SELECT entity, term, count(DISTINCT rid) AS co FROM (SELECT rid, entity, unnest(words) AS term FROM seen) GROUP BY ALL
    ), entity_df AS (
        SELECT entity, count(DISTINCT rid) AS df_entity FROM seen GROUP BY entity
    ), term_df AS (
        SELECT term, count(*) AS df_term FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+'))) AS term FROM docs) GROUP BY term
    ), measured AS (
        SELECT *, ln(n * co / (CAST(df_entity AS DOUBLE) * df_term)) AS mutual,
            CASE WHEN co < df_entity AND df_term < n THEN (df_entity - co) * (ln((df_entity - co) * n) - ln(df_entity * (n - df_term))) ELSE 0 END AS rest
        FROM together JOIN entity_df USING (entity) JOIN term_df USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs)
    ), judged AS (
        SELECT entity, term FROM measured WHERE df_entity < n AND mutual >= 0.9 * ln(n / df_entity) - 1e-9 AND co * mutual + rest >= ln(1000) - 1e-9
    ), told AS (
        SELECT DISTINCT rid, term FROM seen JOIN judged USING (entity)
    ), said AS (
        SELECT doc_id, rid, unnest(m) AS value, unnest(p[:len(m)]) AS piece, unnest(range(len(m))) AS i FROM (
            SELECT doc_id, rid, regexp_extract_all(text, '\\p{{L}}+') AS m, string_split_regex(text, '\\p{{L}}+') AS p FROM docs WHERE rid IN (SELECT rid FROM told))
    ), spans AS (
        SELECT rid, kind, start, stop FROM base
        UNION ALL
        SELECT s.rid, 4, s.stop - length(s.value), s.stop FROM (SELECT *, CAST(sum(length(piece) + length(value)) OVER (PARTITION BY rid ORDER BY i) AS BIGINT) AS stop FROM said) s
        JOIN told ON s.rid = told.rid AND lower(s.value) = told.term
    ), named AS (
        SELECT *, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop AS name FROM spans
    ), by_doc AS (
        SELECT rid, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
            string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 4) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans FROM named GROUP BY rid
    )
    SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN by_doc USING (rid)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, sf_dir))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


_SAID = "</s>[INST] ok [/INST]"
_ESCAPE = "replace(replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '\\<s>'), '<s!>', '\\<s!>'), '</s>', '\\</s>'), '[INST]', '\\[INST]'), '[/INST]', '\\[/INST]')"


@query(
    "op8_chat_formatting",
    f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')
    ), shown AS (
        SELECT *, regexp_matches(text || ' ' || role, '<s>|<s!>|</s>|\\[INST\\]|\\[/INST\\]') OR contains(role, chr(10)) AS hard FROM rows
    ), sized AS (
        SELECT *, CASE WHEN hard
            THEN length('<s!>') + length(replace({_ESCAPE.format('role')}, chr(10), '\\' || chr(10))) + 1 + length({_ESCAPE.format('text')}) + length('</s>') + 1
            ELSE length('<s>') + length(role) + 1 + length(text) + length('</s>') + 1 END AS chars FROM shown
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", _SAID), (-7, 1, "assistant", _SAID)], "conv_id long, turn long, role string, text string")
    return chat.digests(rows.unionByName(added))


@query(
    "op9_embedding_near_dedup",
    """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
    ), reach(a, b) AS (
        SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
    ), least AS (
        SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
    ), degree AS (
        SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
    )
    SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(component_id, vec_id) AS BIGINT) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op10_sum_of_squares_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
