"""The registered queries of this subpackage, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import whole_text
from weftline.llm.exact_dedup import exact_copies
from weftline.llm.hard_negatives import hard_negatives
from weftline.llm.html_text import extract_text
from weftline.llm.impact_search import top_products
from weftline.llm.jaccard_join import similar_documents
from weftline.llm.langid import held_out, identify, learn
from weftline.llm.line_dedup import dedup_lines
from weftline.llm.packing import pack_documents
from weftline.llm.pii import BASE_KINDS, find_pii
from weftline.llm.sentence_pieces import decode, encode
from weftline.llm.spotsigs import compare_edited, fingerprint
from weftline.llm.substring_dedup import dedup_passages
from weftline.llm.turn_repair import repair_reports
from weftline.sources.catalog import parquet_table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256(text: str) -> Column:
    return F.sha2(text, 256)


# White space and A-Z in DuckDB: patterns of RE2, and a translation that leaves other letters alone.
SQL_SPACE = r"[\x20\x09-\x0D]"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {SQL_LOWER.format(f"regexp_replace(line, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')")} AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, coalesce(k.doc_id < s.last, false) AS lost FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_lines(parquet_table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256("text").alias("kept_sha256"))


OP2_SQL = rf"""
WITH digests AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '{SQL_SPACE}+', '', 'g')) AS text_sha256
  FROM documents),
kept AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM digests WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM kept
"""


@query("op2_exact_dedup", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The half of the documents with an even hash of their id is what was there before; the other half arrives."""
    out = exact_copies(parquet_table(spark, folder, "documents"), F.xxhash64("doc_id") % 2 == 0)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split),
windows AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM split WHERE len(words) >= 20),
hashed AS (SELECT doc_id, start, md5(array_to_string(words[start:start + 19], ' ')) AS content FROM windows),
again AS (
  SELECT doc_id, start FROM (
    SELECT doc_id, start, row_number() OVER (PARTITION BY content ORDER BY doc_id, start) AS nth FROM hashed) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM again),
rest AS (
  SELECT p.doc_id, count(*) AS n_words, count(c.pos) AS n_removed, string_agg(p.word, ' ' ORDER BY p.pos) FILTER (WHERE c.pos IS NULL) AS kept
  FROM placed p LEFT JOIN covered c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN rest r ON s.doc_id = r.doc_id
"""


@query("op3_substring_dedup", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    out = dedup_passages(parquet_table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", sha256("text").alias("kept_sha256"))


OP7_SQL = rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({SQL_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS grams FROM split),
grams AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reached(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node)
SELECT s.doc_id, len(s.grams) AS n_shingles, r.root AS component_id
FROM sets s JOIN (SELECT node, min(root) AS root FROM reached GROUP BY node) r ON s.doc_id = r.node
"""


@query("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every text to pieces and back."""
    model = tokenizer("piece_bpe_32k.model")
    docs = parquet_table(spark, folder, "documents").select("doc_id", whole_text().alias("text"))
    coded = docs.withColumn("ids", encode(F.col("text"), model))
    coded = coded.withColumn("decoded", decode(F.col("ids"), model))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        sha256("decoded").alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("same"))


@query("op5_spot_signatures")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    out = compare_edited(parquet_table(spark, folder, "documents"))
    return out.select(
        "doc_id", "n_chars", sha256("edited_text").alias("edited_sha256"), fingerprint("signatures").alias("fingerprint"),
        fingerprint("edited_signatures").alias("edited_fingerprint"), "near_edited", "near_next")


@query("op6_html_text")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    out = extract_text(parquet_table(spark, folder, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op7_ngram_jaccard_join", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(parquet_table(spark, folder, "documents"))


@query("op8_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(parquet_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = parquet_table(spark, folder, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs.filter(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = find_pii(parquet_table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "pii")
    of = lambda *kinds: F.filter("pii", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(of(*BASE_KINDS)), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations after faults that a checksum of conversation and turn decides on; a row that is dropped stays as a row that is not ``present``."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(draw == 4, "user").otherwise(said("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (draw != 0).alias("present"), draw.alias("draw"))
    return rows.withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("draw", "copy")


# The checksum by its bits, since DuckDB has no function for it; the cheapest edits by a recursion over the rows of all conversations at once,
# where each place of the pattern keeps its least (cost, audit) and the repaired text that goes with it.
OP11_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::UBIGINT) AS bytes FROM conversations),
bits AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda crc, byte:
    list_reduce(list_prepend(xor(crc, byte), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)),
    4294967295::UBIGINT) % 20 AS draw FROM given),
hurt AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM bits WHERE draw <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS initial FROM hurt),
judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM placed),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
moves(source, target, made) AS (VALUES ('0', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
inserted AS (
  SELECT source, source AS target, '' AS edits, 0 AS paid, '' AS lines FROM moves
  UNION ALL SELECT source, target, 'I', 2, made || ':' || chr(10) FROM moves
  UNION ALL SELECT m.source, k.target, 'II', 4, m.made || ':' || chr(10) || k.made || ':' || chr(10) FROM moves m JOIN moves k ON k.source = m.target),
steps AS (
  SELECT j.conv_id, j.pos, i.source, e.target, i.edits || e.edit AS edits, i.paid + e.paid + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END AS paid,
    i.lines || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN j.role || ':' || j.text || chr(10) ELSE e.made || ':' || j.text || chr(10) END AS lines
  FROM judged j CROSS JOIN inserted i JOIN (
    SELECT source, source AS target, 'D' AS edit, 3 AS paid, '' AS made, '' AS initial FROM moves
    UNION ALL SELECT source, target, 'R', 2, made, '' FROM moves
    UNION ALL SELECT source, target, 'K', 0, '', target FROM moves
    UNION ALL SELECT '0', 's', 'K', 0, '', 's') e ON e.source = i.target
  WHERE (e.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (e.edit <> 'K' OR e.initial = j.initial)),
ways(conv_id, pos, place, best) AS (
  SELECT conv_id, 0::BIGINT, '0', {'cost': 0, 'audit': '', 'lines': ''} FROM counted
  UNION ALL
  SELECT conv_id, pos, target, min({'cost': cost, 'audit': audit, 'lines': lines}) FROM (
    SELECT w.conv_id, s.pos, s.target, w.best.cost + s.paid AS cost, w.best.audit || s.edits AS audit, w.best.lines || s.lines AS lines
    FROM ways w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.pos = w.pos + 1 AND s.source = w.place)
  GROUP BY conv_id, pos, target),
ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + i.paid, 'audit': w.best.audit || i.edits, 'lines': w.best.lines || i.lines}) AS best
  FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.pos JOIN inserted i ON i.source = w.place AND i.target IN ('0', 'a')
  GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit,
  sha256(coalesce(left(e.best.lines, greatest(length(e.best.lines) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op11_turn_repair", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return repair_reports(damaged(parquet_table(spark, folder, "conversations")), F.col("present"))


OP13_SQL = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


@query("op13_impact_search", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(parquet_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


OP12_SQL = r"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM c.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """One label in seven is wrong: that of the rows whose id is divisible by 7 is the next one."""
    vectors = parquet_table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
