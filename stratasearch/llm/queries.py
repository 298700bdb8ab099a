"""The registered queries of the training-data operators, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    embedding_dedup,
    exact_dedup,
    line_dedup,
    minhash_join,
    packing,
    piece_codec,
    quality_crf,
    token_count,
    toxicity,
    url_rules,
    vector_codes,
)
from .common import table

#: The conversation that op5 formats besides the table's own: its texts hold the template's own marks.
MARKS_INSIDE = r"\### Assistant: </turn> ok"


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, decoded again: doc_id, n_ids, ids_crc32, decoded_chars, decoded_sha256."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_codec.encode_documents(table(spark, sf_dir, "documents"), model)
    counted = encoded.withColumn("n_ids", F.size("ids").cast("long"))
    return piece_codec.decode_ids(counted, model, ("doc_id", "n_ids", "ids_crc32")).select(
        "doc_id",
        "n_ids",
        "ids_crc32",
        F.char_length("text").cast("long").alias("decoded_chars"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has one row per turn; the conversation with marks inside comes as a record with a list of messages."""
    message = F.lit(MARKS_INSIDE).alias("content")
    messages = F.array(*[F.struct(F.lit(role).alias("role"), message) for role in ("user", "assistant")])
    record = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(messages.alias("messages"))).alias("record"))
    marked = chat_format.json_turns(record, "conv_id", "record").select("conv_id", "turn", "role", "text")
    turns = chat_format.table_turns(table(spark, sf_dir, "conversations")).unionByName(marked)
    return chat_format.read_back(chat_format.format_conversations(turns))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as records in six layouts, with fields beyond them and without any layout, as canonical turns."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    lang, source, text = F.col("lang"), F.col("source"), F.col("text")

    def listed(role: str, body: str, names: tuple[str, str]) -> Column:
        return F.array(*[F.struct(F.lit(name).alias(role), value.alias(body)) for name, value in zip(names, (lang, text))])

    records = [
        F.struct(lang.alias("prompt"), text.alias("response")),
        F.struct(listed("role", "content", ("user", "assistant")).alias("messages"), source.alias("source")),
        F.struct(listed("from", "value", ("human", "gpt")).alias("conversations")),
        F.struct(F.col("doc_id").alias("id"), source.alias("instruction"), lang.alias("input"), text.alias("output")),
        F.struct(F.lit("").alias("system"), lang.alias("prompt"), text.alias("response")),
        F.struct(lang.alias("question"), F.struct(text.alias("body")).alias("answer")),
        F.struct(text.alias("body")),
    ]
    record = F.coalesce(*[F.when(F.col("doc_id") % len(records) == k, F.to_json(r)) for k, r in enumerate(records)])
    turns = chat_format.json_turns(rows.select("doc_id", record.alias("record")), "doc_id", "record")
    named = F.when(F.col("record").isNull(), F.col("layout")).alias("layout")
    return turns.select(F.col("conv_id").alias("doc_id"), "turn", "role", F.md5("text").alias("text_md5"), named)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without later copies of repeated runs: doc_id, removed_lines, kept_chars, text_sha256."""
    cut = line_dedup.drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return cut.select(
        "doc_id", "removed_lines", F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("text_sha256")
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_count": op1_token_count,
    "op2_minhash_join": op2_minhash_join,
    "op3_piece_codec": op3_piece_codec,
    "op4_packing": op4_packing,
    "op5_chat_format": op5_chat_format,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_quality": op9_quality,
    "op10_url_rules": op10_url_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_toxicity": op12_toxicity,
    "chat_layouts": chat_layouts,
}

#: translate() with A-Z and a-z.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _codes_sql(rounds: int = 4) -> str:
    """Codebooks of the vectors' quarters; distances are whole numbers in double precision, with the index in the last eight bits."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
          SELECT p.id, p.part, any_value(p.q) AS q, min(CAST(list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c) AS BIGINT) * 256 + entry) AS m
          FROM p JOIN c{k} ON p.part = c{k}.part GROUP BY p.id, p.part)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT part, m % 256 AS entry, i, floor(sum(q[i]) / count(*)) AS x FROM a{k}, unnest(range(1, len(q) + 1)) AS u(i) GROUP BY ALL),
        n{k} AS (SELECT part, entry, list(x ORDER BY i) AS moved FROM s{k} GROUP BY ALL),
        c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(moved, c) AS c FROM c{k} LEFT JOIN n{k} USING (part, entry))""")
    return f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(1024e0 * CAST(x AS DOUBLE))) AS e
          FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT id, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS q FROM v, range(4) AS t(part)),
        c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, q AS c FROM p WHERE id <= 256),
        {", ".join(steps)},
        h AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM c{rounds}, unnest(range(1, len(c) + 1)) AS u(i)),
        o AS (SELECT id, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (id), h
    """


ORACLE_SQL = {
    "op2_minhash_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws
            ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w),
        e AS (SELECT doc_id, unnest(sh) AS x FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * k >= 80 * (len(p.sh) + len(q.sh) - k)),
        r(id, to_id) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.to_id = l.a)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
        FROM s JOIN (SELECT id, min(to_id) AS component_id FROM r GROUP BY id) m ON m.id = s.doc_id
    """,
    "op5_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        e AS (SELECT *, regexp_replace(role, '([\\#<:])', '\\\1', 'g') AS role_out, regexp_replace(text, '([\\#<])', '\\\1', 'g') AS text_out FROM c)
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(length(role_out) + length(text_out) + length('### : </turn>') + 1) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "chat_layouts": """
        WITH d AS (SELECT doc_id, doc_id % 7 AS k, lang, source, coalesce(text, '') AS text FROM documents),
        n(k, layout) AS (VALUES (0, 'prompt and response'), (1, 'messages'), (2, 'conversations'), (3, 'instruction with input'), (4, 'system and prompt'), (5, 'question and answer')),
        t AS (
          SELECT doc_id, k, 0 AS turn, 'user' AS role, CASE WHEN k = 3 THEN source ELSE lang END AS text FROM d WHERE k < 6
          UNION ALL SELECT doc_id, k, 1, 'user', lang FROM d WHERE k = 3 AND lang <> ''
          UNION ALL SELECT doc_id, k, CASE WHEN k = 3 AND lang <> '' THEN 2 ELSE 1 END, 'assistant', CASE WHEN k = 5 THEN CAST(to_json({'body': text}) AS VARCHAR) ELSE text END FROM d WHERE k < 6)
        SELECT doc_id, CAST(turn AS BIGINT) AS turn, role, md5(text) AS text_md5, layout FROM t JOIN n USING (k)
        UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL FROM d WHERE k = 6
    """,
    "op6_line_dedup": f"""
        WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, string_split({_LOW}, chr(10)) AS low FROM documents),
        l AS (SELECT doc_id, i, ls[i] AS line, regexp_extract_all(low[i], '[^\\x20\\x09-\\x0D]+') AS ws FROM t, unnest(range(1, len(ls) + 1)) AS u(i)),
        c AS (SELECT doc_id, i, line, array_to_string(ws, ' ') AS words, len(ws) AS n, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l),
        p AS (SELECT x.doc_id, x.i AS a, y.i AS b, x.n AS na, y.n AS nb FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.n >= 50),
        w AS (SELECT doc_id, a, min(b) AS b FROM p WHERE na > 0 GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM p WHERE nb > 0 GROUP BY doc_id, b),
        k AS (SELECT w.doc_id, w.a, w.b, string_agg(c.words, chr(10) ORDER BY c.i) AS content FROM w JOIN c ON c.doc_id = w.doc_id AND c.i BETWEEN w.a AND w.b GROUP BY ALL),
        f AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) AS place FROM k),
        gone AS (SELECT DISTINCT c.doc_id, c.i FROM f JOIN c ON c.doc_id = f.doc_id AND c.i BETWEEN f.a AND f.b WHERE f.place > 1),
        r AS (SELECT c.doc_id, count(g.i) AS removed, coalesce(string_agg(c.line, chr(10) ORDER BY c.i) FILTER (g.i IS NULL), '') AS kept
          FROM c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.i = c.i GROUP BY c.doc_id)
        SELECT d.doc_id, CAST(coalesce(removed, 0) AS BIGINT) AS removed_lines, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS text_sha256
        FROM documents d LEFT JOIN r USING (doc_id)
    """,
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOW}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
          WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.95e0),
        r(id, to_id) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.to_id = l.a)
        SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
        FROM v JOIN (SELECT id, min(to_id) AS component_id FROM r GROUP BY id) m ON m.id = v.vec_id
    """,
    "op10_url_rules": r"""
        WITH p AS (
          SELECT page_id,
            CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
            CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
          FROM pages),
        r(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
          ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        hit AS (
          SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
            row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS k
          FROM p LEFT JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE k = 1
    """,
    "op11_vector_codes": _codes_sql(),
}
