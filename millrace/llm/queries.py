"""Registered queries of the training-data operators and, where SQL can express them, their counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import ball_tree_search, chat_formatting, decontamination, html_extraction, jaccard_join, language_id, merkle_manifest, nearest_neighbours, prefix_bpe, quality_classifier, source_mixing, token_counts, token_output
from millrace.llm.shared import held_out, table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("op1_token_output")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_output.encode_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


@query("op4_nearest_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 4096)


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = language_id.learn(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, ["doc_id", "held_out"])


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").where(~held_out())
    model = quality_classifier.learn(docs, labels)
    return quality_classifier.classify(docs, model, ["doc_id", "held_out"])


OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5)
           / 4503599627370496.0 AS u, coalesce(md5(text), '') AS digest
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS source_docs,
         [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS room, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS wanted,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER before, 0.0) AS room_before
  FROM sources
  WINDOW before AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, max(CASE WHEN (wanted - room_before) / weight_left * weight < room
                     THEN (wanted - room_before) / weight_left END) OVER () AS level FROM ranked),
targets AS (
  SELECT source, source_size, source_docs, least(room, coalesce(level * weight, room))::DOUBLE AS target FROM levels),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM targets),
chances AS (
  SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS chance, target - floor(ratio) * source_size AS need FROM shares),
odds AS (
  SELECT s.doc_id, s.size, s.digest, c.*, u,
         (u / (1.0::DOUBLE - u)) * ((1.0::DOUBLE - chance) / nullif(chance, 0))
           / CASE WHEN source_size > 0 THEN greatest(least((s.size * source_docs)::DOUBLE / source_size, 4.0::DOUBLE), 0.25::DOUBLE) ELSE 1.0::DOUBLE END AS q
  FROM sized s JOIN chances c ON s.source IS NOT DISTINCT FROM c.source),
order_ AS (
  SELECT *, CASE WHEN chance > 0 AND chance < 1 THEN q / (1.0::DOUBLE + q) ELSE u END AS rank FROM odds),
running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS until
  FROM order_)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN chance > 0 AND until <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running
"""


@query("op3_source_mixing", OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents"))


OP10 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>') AS body,
         replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '\</turn>'), chr(10), '\n') AS head
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length('### ' || head || ':' || chr(10) || body || chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query("op10_chat_formatting", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    whole = chat_formatting.format_branches(chat_formatting.chains(turns))
    back = whole.select(
        F.col("tree").alias("conv_id"),
        "formatted",
        chat_formatting.parse(F.col("formatted")).alias("turns"),
        chat_formatting.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP11 = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS ws
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, ws, len(ws) AS n FROM words WHERE len(ws) > 0),
total AS (SELECT count(*) AS docs_n, CAST(sum(n) AS BIGINT) AS length FROM docs),
tf AS (SELECT r, t, count(*) AS times FROM (SELECT r, unnest(ws) AS t FROM docs) GROUP BY r, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
terms AS (
  SELECT DISTINCT item_id, t FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS t
    FROM benchmark WHERE text IS NOT NULL)),
scores AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * times) // (1000 * times + 8 * (10 + (90 * n * docs_n) // length)))) AS BIGINT) AS score
  FROM terms JOIN weights USING (t) JOIN tf USING (t) JOIN docs USING (r), total
  GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


@query("op11_ball_tree_search", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_prefix_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = prefix_bpe.encode(table(spark, sf_dir, "documents"), path, pattern, ["doc_id"])
    back = prefix_bpe.decode(encoded, path, pattern, ["doc_id"])
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP13 = r"""
WITH RECURSIVE framed AS (
  SELECT doc_id, source, crc32_even,
         f_id || f_source || f_lang || f_chars || coalesce(strlen(text) || ':' || text, '-') AS whole,
         f_id || f_source || f_lang || f_chars || coalesce(strlen(bare) || ':' || bare, '-') AS cut
  FROM (SELECT *, replace(text, chr(10), '') AS bare,
               coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS f_id,
               coalesce(strlen(source) || ':' || source, '-') AS f_source,
               coalesce(strlen(lang) || ':' || lang, '-') AS f_lang,
               coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS f_chars,
               list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
                 lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]),
                   lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) & 1 = 1 AS crc32_even
        FROM documents)),
leaves AS (
  SELECT doc_id, source, sha256(whole) AS leaf, sha256(CASE WHEN crc32_even THEN cut ELSE whole END) AS given,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(whole)) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n
  FROM framed),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER () AS r FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS h FROM numbered
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n),
tops AS (SELECT tree, level AS depth, h AS subroot FROM nodes WHERE n = 1),
joints AS (
  SELECT 0 AS level, tree - 1 AS idx, count(*) OVER () AS n, subroot AS h FROM tops
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM joints WHERE n > 1 GROUP BY level, idx // 3, n),
sides AS (
  SELECT a.tree, a.level, a.idx, string_agg(CASE WHEN b.idx < a.idx THEN b.h END, '' ORDER BY b.idx) AS l,
         string_agg(CASE WHEN b.idx > a.idx THEN b.h END, '' ORDER BY b.idx) AS r
  FROM (SELECT tree, level, idx, n, h FROM nodes UNION ALL SELECT 0, level, idx, n, h FROM joints) a
  JOIN (SELECT tree, level, idx, h FROM nodes UNION ALL SELECT 0, level, idx, h FROM joints) b
    ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
  WHERE a.n > 1 GROUP BY ALL),
folded AS (
  SELECT n.r AS leaf_row, 0 AS step, CASE WHEN depth = 0 THEN 0 ELSE tree END AS at_tree, 0 AS level,
         CASE WHEN depth = 0 THEN tree - 1 ELSE idx END AS idx, tree, depth, given AS h, '' AS proof
  FROM numbered n JOIN tops USING (tree)
  UNION ALL
  SELECT leaf_row, step + 1, CASE WHEN up THEN 0 ELSE at_tree END, CASE WHEN up THEN 0 ELSE level + 1 END,
         CASE WHEN up THEN tree - 1 ELSE idx // 3 END, tree, depth, h, proof
  FROM (SELECT f.leaf_row, f.step, f.at_tree, f.level, f.idx, f.tree, f.depth, f.at_tree > 0 AND f.level + 1 = f.depth AS up,
               sha256(coalesce(s.l, '') || f.h || coalesce(s.r, '')) AS h, f.proof || coalesce(s.l, '') || coalesce(s.r, '') AS proof
        FROM folded f JOIN sides s ON s.tree = f.at_tree AND s.level = f.level AND s.idx = f.idx)),
ended AS (SELECT leaf_row, arg_max(h, step) AS folded_root, sha256(arg_max(proof, step)) AS proof_sha256 FROM folded GROUP BY leaf_row)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM numbered JOIN tops USING (tree) JOIN ended ON leaf_row = r, (SELECT h AS root FROM joints WHERE n = 1)
"""


@query("op13_merkle_manifest", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified(table(spark, sf_dir, "documents"))
