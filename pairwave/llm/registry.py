"""The registered queries of the text operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairwave.llm import conv_trie, decontam, html_extract, langid, minhash, quality, resample, secrets, sentencepiece, simhash, token_count, token_output, warc
from pairwave.llm.common import read


def tokenizer(name: str) -> str:
    """Where the public tokenizer files of this machine are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents"), quality.untoxic(read(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(read(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.counted(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.reported(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encoded(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), with_ids=False)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited(read(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.trie(read(spark, sf_dir, "conversations"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_language": op3_language,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_decontamination": op8_decontamination,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_output": op10_token_output,
    "op11_minhash": op11_minhash,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_resampling": op13_resampling,
}


def crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes: one table look-up a byte; the table comes from the polynomial, its eight steps a byte."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    one = f"instr('0123456789ABCDEF', substr(hex(encode({text})), k, 1)) - 1"
    other = f"instr('0123456789ABCDEF', substr(hex(encode({text})), k + 1, 1)) - 1"
    bytes_ = f"list_transform(range(1, 2 * strlen({text}), 2), lambda k: (16 * ({one}) + {other})::BIGINT)"
    return f"xor(list_reduce({bytes_}, lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def trie_sql() -> str:
    """Paths as lists of digests of their prefixes, chained; subtrees by joins of members with their own later nodes."""
    return f"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, conv_id - conv_id % {conv_trie.SPAN} AS base, {crc32_sql("s")} % {conv_trie.LENT} AS h
            FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM t)
        ), r AS (
            SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
            UNION ALL
            SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
        ), l AS (
            SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY part, pos) AS turns, list(length(text) ORDER BY part, pos) AS sizes FROM r GROUP BY conv_id
        ), p AS (
            SELECT c.conv_id, coalesce(len(l.turns), 0) AS n, d, coalesce(array_to_string(l.turns[1:d], ','), '') AS node,
                   CASE WHEN d > 0 THEN array_to_string(l.turns[1:d-1], ',') END AS parent, CASE WHEN d > 0 THEN l.sizes[d] ELSE 0 END AS tokens
            FROM c LEFT JOIN l USING (conv_id), unnest(range(0, coalesce(len(l.turns), 0) + 1)) AS u(d)
        ), v AS (
            SELECT node, d, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, max(tokens) AS tokens, bool_and(n = d) AS leaf,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
            FROM p GROUP BY node, d
        ), s AS (
            SELECT a.node, a.d, count(*) FILTER (v.leaf) AS n_leaves, sum((v.n_convs - 1) * v.tokens) AS saved_tokens
            FROM (SELECT DISTINCT a.node, a.d, b.node AS below, b.d AS below_d FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.d >= a.d) a
            JOIN v ON v.node = a.below AND v.d = a.below_d GROUP BY a.node, a.d
        ), k AS (
            SELECT parent, d - 1 AS d, count(*) AS n_children FROM v WHERE d > 0 GROUP BY parent, d
        )
        SELECT v.conv_id, v.d::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
               s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
        FROM v JOIN s ON s.node = v.node AND s.d = v.d LEFT JOIN k ON k.parent = v.node AND k.d = v.d LEFT JOIN v up ON up.node = v.parent AND up.d = v.d - 1
    """


def resampling_sql() -> str:
    """Distinct features counted and hashed once, buckets summed, gains joined back to each document's features."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{resample.UPPER}', '{resample.LOWER}'), '{resample.WORD}')"
    each = """SELECT {0}, unnest(w) AS f FROM {1} UNION ALL SELECT {0}, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM {1}
              UNION ALL SELECT {0}, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) FROM {1}"""
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
        b AS (SELECT {words} AS w FROM benchmark),
        e AS ({each.format("r", "d")}), g AS ({each.format("0 AS r", "b")}),
        n AS (SELECT r, f, count(*) AS n FROM e GROUP BY r, f),
        k AS (SELECT f, {crc32_sql("f")} % {resample.BUCKETS} AS bucket FROM (SELECT f FROM n UNION SELECT f FROM g)),
        s AS (SELECT bucket, sum(n) AS s FROM n JOIN k USING (f) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (f) GROUP BY bucket),
        x AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {resample.BUCKETS})::DOUBLE
                     / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {resample.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
        w AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM n JOIN k USING (f) JOIN x USING (bucket) GROUP BY r),
        a AS (SELECT d.r, doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                     coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
              FROM d LEFT JOIN w USING (r)),
        z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM a WHERE n_words >= {resample.MIN_WORDS})
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {resample.PERCENT} * count(*) // 100 FROM z) THEN place END AS rank, n_words
        FROM a LEFT JOIN z USING (r)
    """

def secrets_sql() -> str:
    """For each rule, offsets from the lengths of matches and of what lies between; then all spans of a text in order."""
    parts, lists = [], []
    for k, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        if p == "[0-9a-f]+":  # runs are maximal either way
            p = f"[0-9a-f]{{{r.least},}}"
        parts.append(f"regexp_extract_all(t, '{p}', 0) AS m{k}, string_split_regex(t, '{p}') AS g{k}, regexp_extract_all(t, '{p}', {r.group}) AS c{k}")
        lists.append(f"""list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{
            's': list_sum(list_transform(g{k}[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m{k}[1:i-1], lambda x: length(x))), 0)::BIGINT,
            'k': {k}, 'n': length(m{k}[i]), 'c': length(c{k}[i])}}), lambda x: x.c >= {r.least})""")
    name = "CASE x.k " + " ".join(f"WHEN {k} THEN '{r.kind}'" for k, r in enumerate(secrets.RULES)) + " END"
    spans = lambda of: f"coalesce(list_aggregate(list_transform({of}, lambda x: {name} || ':' || x.s || ':' || (x.s + x.n)), 'string_agg', ','), '')"
    base = "list_filter(f, lambda x: x.k < 3)"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        p AS (SELECT doc_id, {", ".join(parts)} FROM d),
        a AS (SELECT doc_id, list_sort(flatten([{", ".join(lists)}])) AS f FROM p)
        SELECT doc_id, {", ".join(f"len(list_filter(f, lambda x: x.k = {k}))::BIGINT AS n_{n}" for k, n in enumerate(secrets.BASE))},
               sha256({spans(base)}) AS base_sha256, {spans("f")} AS spans
        FROM a
    """


ORACLE_SQL: dict[str, str] = {
    "op12_conversation_trie": trie_sql(),
    "op13_resampling": resampling_sql(),
    "op7_secrets": secrets_sql(),
    "op4_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
        ), b AS (
            SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS best FROM p
        )
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to
        FROM b
    """,
}
