"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, hard_negatives, html_extract, line_dedup, merkle, mixing, ngram_join, pii, quality, simhash, spm, warc
from .common import ensure_checkpoint_dir, read, text_of


def piece_model() -> str:
    """The public merge-type model all executors have; a parameter of the operator."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.sanitise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
                    listed(F.concat("base_spans", "term_spans")).alias("spans"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(read(spark, sf_dir, "documents"))
    rows = plan.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP2_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sizes GROUP BY source),
w AS (SELECT *, CAST((rk - 1) % 3 + 1 AS DOUBLE) AS w, 3 * s AS cap FROM per),
fill AS (SELECT *, (SELECT sum(s) FROM per) - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains,
  sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM w),
lev AS (SELECT remains / ws AS level FROM fill WHERE NOT cap * ws <= remains * w ORDER BY cap / w, rk LIMIT 1),
t AS (SELECT source, rk, CAST(s AS BIGINT) AS source_size, CASE WHEN cap * ws <= remains * w THEN cap ELSE w * (SELECT level FROM lev) END AS target FROM fill),
q AS (SELECT z.doc_id, z.size, t.rk, t.source_size, t.target,
  sum(z.size) OVER (PARTITION BY t.rk ORDER BY md5('0:' || coalesce(CAST(z.doc_id AS VARCHAR), '')), z.doc_id, z.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM sizes z JOIN t ON z.source IS NOT DISTINCT FROM t.source WHERE z.size > 0 AND t.target > 0),
f AS (SELECT q.*, e.e, (e.e * q.source_size + q.cum) / q.target AS finish FROM q, (VALUES (0), (1), (2)) e(e) WHERE e.e * q.source_size + q.cum - q.size < q.target),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, rk ROWS UNBOUNDED PRECEDING) AS total FROM f),
c AS (SELECT doc_id, sum(size) AS taken FROM g WHERE total <= (SELECT sum(size) FROM sizes) GROUP BY doc_id)
SELECT z.doc_id, z.size, t.source_size, t.target, CAST(coalesce(c.taken, 0) AS BIGINT) AS taken
FROM sizes z JOIN t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON z.doc_id = c.doc_id
"""


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    manifest = warc.write_archives(read(spark, sf_dir, "pages"), folder)
    return warc.read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         CASE WHEN octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY coalesce(html, ''))
              THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) END AS refers_to
  FROM pages)
"""


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_decode(read(spark, sf_dir, "documents"), piece_model(), ids_out=False)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), shingle_words=3, num=90, den=100)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1, near_chars=1)
    listed = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["pos"].cast("string"), r["keep_doc"].cast("string"))), ",")
    return d.select("doc_id", "n_lines", "n_removed", listed.alias("removed"), F.sha2(text_of("text"), 256).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(text_of("text"), 256).alias("text_sha256"))
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


TOOLS = {
    "label": {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}}},
    "reply": {"type": "object", "required": ["label", "prompt", "words"], "additionalProperties": False,
              "properties": {"context": {"type": "string"}, "label": {"type": "string"}, "prompt": {"type": "string", "minLength": 1},
                             "words": {"type": "integer", "minimum": 1}}},
}


def turns_with_calls(turns: DataFrame) -> DataFrame:
    """The table's conversations with tool calls.

    Its turns are prose.  Each user turn becomes a turn that calls ``reply``, which needs the result of a ``label`` call listed after
    it and of the reply before it, and the assistant turn that follows is the result of that reply.
    """
    name = lambda tool, back: F.concat_ws("-", F.lit(tool), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    result = lambda tool, back: F.struct(name(tool, back).alias("$result"))
    args = F.struct(F.when(F.col("turn") >= 2, result("reply", 2)).alias("context"), result("label", 0).alias("label"), text_of("text").alias("prompt"),
                    F.size(F.split(text_of("text"), " ")).alias("words"))
    # to_json leaves out null fields, so a first turn has no context
    reply = F.to_json(F.struct(name("reply", 0).alias("id"), F.lit("reply").alias("name"), args.alias("arguments")))
    label = F.to_json(F.struct(name("label", 0).alias("id"), F.lit("label").alias("name"), F.struct(text_of("text").alias("text")).alias("arguments")))
    call = F.concat(F.lit('{"content":null,"tool_calls":['), reply, F.lit(","), label, F.lit("]}"))
    answer = F.to_json(F.struct(name("reply", 1).alias("tool_call_id"), text_of("text").alias("content")))
    role = F.col("role")
    return turns.select("conv_id", "turn", F.when(role == "user", "assistant").when(role == "assistant", "tool").otherwise(role).alias("role"),
                        F.when(role == "user", call).when(role == "assistant", answer).otherwise(text_of("text")).alias("text"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(turns_with_calls(read(spark, sf_dir, "conversations")), TOOLS)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("lang")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = read(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"), merkle.without_newlines())


QUERIES = {f.__name__: f for f in (op1_pii, op2_mix_sources, op3_html_extract, op4_warc, op5_sentencepiece, op6_ngram_join, op7_line_dedup, op8_exact_dedup, op9_chat_format, op10_quality_rules, op11_hard_negatives, op12_simhash, op13_merkle)}
SQL = {"op2_mix_sources": OP2_SQL, "op4_warc": OP4_SQL, "op8_exact_dedup": OP8_SQL, "op11_hard_negatives": OP11_SQL}


def _bind(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    run.__name__ = f"q_{fn.__name__}"
    return run


def queries() -> dict:
    return {name: _bind(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
