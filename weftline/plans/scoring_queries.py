"""Text, metric and evaluation operators over the conversation corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import metrics as M
from weftline.functions import prompts as P
from weftline.functions import text as X
from weftline.operators import evaluate as E
from weftline.operators.ngrams import token_scores
from weftline.operators.positions import dense_ordinal
from weftline.plans.corpus import OPS_SQL, example_pairs, sql_normalize, sql_strip, sql_tokens, with_pairs
from weftline.plans.registry import Tables, query
from weftline.session import stored

DIGITS = 9  # scores are compared to this many decimals


def quoted(text: str) -> str:
    """A text constant as SQL."""
    return "'" + text.replace("'", "''") + "'"


W = P.DEFAULT_WORDING
SYSTEM = quoted(W.system)

# -- text ----------------------------------------------------------------------------------------


def _flat(messages):
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "||")


@query("x01_chat_messages", with_pairs(f"""
SELECT example_id, 3 AS turns,
  md5('system|' || {SYSTEM} || '||user|' || description || '||assistant|' || code) AS digest FROM corpus"""))
def x01(t: Tables) -> DataFrame:
    messages = P.chat_messages("description", "code")
    return example_pairs(t).select("example_id", F.size(messages).alias("turns"), F.md5(_flat(messages)).alias("digest"))


CHATML_SQL = (
    f"'<|im_start|>system' || chr(10) || {SYSTEM} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)"
    " || description || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || code || '<|im_end|>'"
)


@query("x02_chatml_text", with_pairs(
    f"SELECT example_id, length(x) AS n_chars, md5(x) AS digest FROM (SELECT example_id, {CHATML_SQL} AS x FROM corpus)"))
def x02(t: Tables) -> DataFrame:
    text = P.chatml_text("description", "code")
    return example_pairs(t).select("example_id", F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


_INSTRUCTION_SQL = (
    f"{quoted(W.instruction_intro)} || chr(10) || chr(10) || '### Instruction:' || chr(10) || "
    f"{quoted(W.instruction_task)} || chr(10) || description || chr(10) || chr(10) || '### Response:' || chr(10) || code"
)


@query("x03_instruction_text", with_pairs(f"SELECT example_id, md5({_INSTRUCTION_SQL}) AS digest FROM corpus"))
def x03(t: Tables) -> DataFrame:
    return example_pairs(t).select("example_id", F.md5(P.instruction_text("description", "code")).alias("digest"))


@query("x04_few_shot_block", with_pairs("""
SELECT example_id, md5('Request: ' || description || chr(10) || 'Code:' || chr(10) || code || chr(10) || '---') AS digest
FROM corpus"""))
def x04(t: Tables) -> DataFrame:
    return example_pairs(t).select("example_id", F.md5(P.few_shot_block("description", "code")).alias("digest"))


@query("x06_zero_shot_messages", with_pairs(f"""
SELECT example_id, 2 AS turns, md5('system|' || {SYSTEM} || '||user|' || description) AS digest FROM corpus"""))
def x06(t: Tables) -> DataFrame:
    messages = P.chat_messages("description")
    return example_pairs(t).select("example_id", F.size(messages).alias("turns"), F.md5(_flat(messages)).alias("digest"))


@query("x07_system_rules", with_pairs(f"SELECT example_id, {SYSTEM} AS system FROM corpus"))
def x07(t: Tables) -> DataFrame:
    return example_pairs(t).select("example_id", F.lit(P.SYSTEM_RULES).alias("system"))


_FENCE_SQL = X.FENCE.replace("'", "''")


@query("x08_extract_code", with_pairs(f"""
SELECT example_id, CASE WHEN regexp_matches(raw_output, '{_FENCE_SQL}')
  THEN {sql_strip(f"regexp_extract(raw_output, '{_FENCE_SQL}', 1)")} ELSE {sql_strip('raw_output')} END AS code
FROM corpus"""))
def x08(t: Tables) -> DataFrame:
    return example_pairs(t).select("example_id", X.extract_code("raw_output").alias("code"))


@query("x09_normalize_space", f"""
SELECT doc_id, length({sql_normalize('text')}) AS n_chars, md5({sql_normalize('text')}) AS digest FROM documents""")
def x09(t: Tables) -> DataFrame:
    clean = t.documents.select("doc_id", X.normalize_space("text").alias("clean"))
    return clean.select("doc_id", F.length("clean").alias("n_chars"), F.md5("clean").alias("digest"))


@query("x10_tokens", f"""
SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w, '|')) AS digest
FROM (SELECT doc_id, {sql_tokens('text')} AS w FROM documents)""")
def x10(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", X.tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", "|")).alias("digest"))


@query("x11_previews", """
SELECT doc_id, substr(text, 1, 60) || '...' AS p60, substr(text, 1, 100) || '...' AS p100,
  substr(text, 1, 200) || '...' AS p200 FROM documents""")
def x11(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *[X.preview("text", n).alias(f"p{n}") for n in (60, 100, 200)])


@query("x12_score_format", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.4f', l_quantity / 64) AS quantity_share,
  printf('%.4f', l_quantity / 160) AS quantity_score, printf('%.4f', l_discount) AS discount FROM lineitem""")
def x12(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        X.fixed4(F.col("l_quantity") / 64).alias("quantity_share"),
        X.fixed4(F.col("l_quantity") / 160).alias("quantity_score"),
        X.fixed4("l_discount").alias("discount"),
    )


@query("p02_corpus_preview", with_pairs("""
SELECT example_id, '[' || complexity || '] ' || substr(description, 1, 80) || '...' AS preview FROM corpus"""))
def p02(t: Tables) -> DataFrame:
    return example_pairs(t).select("example_id", X.tagged_preview("complexity", "description").alias("preview"))


@query("p03_index_projection", with_pairs("SELECT example_id, description, code FROM corpus"))
def p03(t: Tables) -> DataFrame:
    return example_pairs(t).select("example_id", "description", "code")


@query("p07_first_record", with_pairs("""
SELECT example_id, description, code, array_to_string(tables, ',') AS tables,
  array_to_string(operations, ',') AS operations, complexity FROM corpus ORDER BY example_id LIMIT 1"""))
def p07(t: Tables) -> DataFrame:
    first = example_pairs(t).orderBy("example_id").limit(1)
    return first.select(
        "example_id", "description", "code", F.array_join("tables", ",").alias("tables"),
        F.array_join("operations", ",").alias("operations"), "complexity",
    )


# -- metrics -----------------------------------------------------------------------------------------

_PATTERNS_SQL = [p.replace("'", "''") for p in M.PATTERNS]


def sql_patterns(c: str) -> str:
    found = ", ".join(f"regexp_extract_all({c}, '{p}', 1)" for p in _PATTERNS_SQL)
    return f"list_distinct(list_concat({found}))"


METRICS_SQL = f"""
parts AS (
  SELECT example_id, description, {sql_tokens('code')} AS r, {sql_tokens('candidate')} AS c,
    {sql_normalize('code')} = {sql_normalize('candidate')} AS exact_match,
    list_filter({OPS_SQL}, lambda o: contains(code, o)) AS ops_r,
    list_filter({OPS_SQL}, lambda o: contains(candidate, o)) AS ops_c,
    {sql_patterns('code')} AS pat_r, {sql_patterns('candidate')} AS pat_c
  FROM corpus),
grams AS (
  SELECT example_id, n, array_to_string(r[i:i + n - 1], ' ') AS g, 1 AS in_r, 0 AS in_c
  FROM parts, range(1, 5) AS a(n), range(1, len(r) - n + 2) AS b(i)
  UNION ALL
  SELECT example_id, n, array_to_string(c[i:i + n - 1], ' '), 0, 1
  FROM parts, range(1, 5) AS a(n), range(1, len(c) - n + 2) AS b(i)),
counted AS (SELECT example_id, n, g, sum(in_r) AS cr, sum(in_c) AS cc FROM grams GROUP BY ALL),
matched AS (
  SELECT example_id, n, sum(least(cr, cc)) AS m, sum(CASE WHEN cr > 0 THEN cc ELSE 0 END) AS known
  FROM counted GROUP BY ALL),
precisions AS (
  SELECT example_id, n, coalesce(m, 0) AS m, coalesce(known, 0) AS known, len(r) AS lr, len(c) AS lc,
    CASE WHEN coalesce(m, 0) = 0 THEN 0.1::DOUBLE ELSE m::DOUBLE END / greatest(1, len(c) - n + 1) AS p
  FROM parts CROSS JOIN range(1, 5) AS a(n) LEFT JOIN matched USING (example_id, n)),
token_scores AS (
  SELECT example_id,
    CASE WHEN lc = 0 OR sum(CASE WHEN n = 1 THEN m END) = 0 THEN 0
      ELSE CASE WHEN lc > lr THEN 1 ELSE exp(1 - lr / lc) END * exp(sum(ln(p)) / 4) END AS bleu,
    CASE WHEN lc = 0 THEN 0 ELSE sum(CASE WHEN n = 1 THEN known END)::DOUBLE / lc END AS unigram_precision
  FROM precisions GROUP BY example_id, lr, lc),
scores AS (
  SELECT example_id, description, bleu, unigram_precision, exact_match,
    CASE WHEN len(ops_r) = 0 THEN 1 ELSE len(list_intersect(ops_r, ops_c)) / len(ops_r) END::DOUBLE
      AS operation_coverage,
    CASE WHEN len(pat_r) = 0 AND len(pat_c) = 0 THEN 1
      ELSE len(list_intersect(pat_r, pat_c)) / len(list_distinct(list_concat(pat_r, pat_c))) END::DOUBLE
      AS structural_similarity
  FROM parts JOIN token_scores USING (example_id))
"""


def with_scores(select: str, *ctes: str) -> str:
    return with_pairs(select, METRICS_SQL, *ctes)


@query("e01_exact_match", with_scores("SELECT example_id, exact_match FROM scores"))
def e01(t: Tables) -> DataFrame:
    return example_pairs(t).select("example_id", M.exact_match("code", "candidate").alias("exact_match"))


def spread_pairs(t: Tables) -> DataFrame:
    """The pairs dealt over the session's tasks: n-grams are much work for few bytes, and a small file is one task."""
    pairs = example_pairs(t)
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "example_id")


@query("e02_bleu4", with_scores(f"SELECT example_id, round(bleu, {DIGITS}) AS bleu FROM scores"))
def e02(t: Tables) -> DataFrame:
    return token_scores(spread_pairs(t)).select("example_id", F.round("bleu", DIGITS).alias("bleu"))


@query("e03_unigram_precision", with_scores("SELECT example_id, unigram_precision FROM scores"))
def e03(t: Tables) -> DataFrame:
    return token_scores(spread_pairs(t)).select("example_id", "unigram_precision")


@query("e04_operations", with_scores("SELECT example_id, array_to_string(ops_r, ',') AS operations FROM parts"))
def e04(t: Tables) -> DataFrame:
    return example_pairs(t).select("example_id", F.array_join(M.operations_in("code"), ",").alias("operations"))


@query("e05_operation_coverage", with_scores("SELECT example_id, operation_coverage FROM scores"))
def e05(t: Tables) -> DataFrame:
    return example_pairs(t).select(
        "example_id", M.operation_coverage("code", "candidate").alias("operation_coverage")
    )


@query("e06_patterns", with_scores("""
SELECT example_id, len(pat_r) AS n_patterns, array_to_string(list_sort(pat_r), '|') AS patterns FROM parts
UNION ALL
SELECT page_id, len(p), array_to_string(list_sort(p), '|') FROM html""", f"""
html AS (SELECT page_id, {sql_patterns('html')} AS p FROM pages)"""))
def e06(t: Tables) -> DataFrame:
    """Over generated code and over raw web pages, whose quotes and calls are less regular."""
    codes = example_pairs(t).select("example_id", M.patterns_in("code").alias("p"))
    pages = t.pages.select("page_id", M.patterns_in("html").alias("p"))
    return codes.union(pages).select(
        "example_id", F.size("p").alias("n_patterns"), F.array_join(F.array_sort("p"), "|").alias("patterns")
    )


@query("e07_structural_similarity", with_scores("SELECT example_id, structural_similarity FROM scores"))
def e07(t: Tables) -> DataFrame:
    return E.row_scores(example_pairs(t), ["example_id"]).select("example_id", "structural_similarity")


# -- evaluation --------------------------------------------------------------------------------------

_MEANS_SQL = ", ".join(
    f"round(avg({m}), {DIGITS}) AS {m}"
    for m in ("bleu", "exact_match::INTEGER", "operation_coverage", "structural_similarity")
).replace("AS exact_match::INTEGER", "AS exact_match")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


@query("e08_aggregate", with_scores(f"SELECT {_MEANS_SQL} FROM scores"))
def e08(t: Tables) -> DataFrame:
    return _rounded(E.aggregate(E.evaluate(spread_pairs(t))), *E.METRICS)


@query("e09_unmatched_ids", with_pairs("""
SELECT coalesce(e.example_id, p.example_id) AS example_id,
  CASE WHEN p.example_id IS NULL THEN 'example' WHEN e.example_id IS NULL THEN 'prediction' END AS unmatched
FROM corpus e FULL JOIN (
  SELECT CASE WHEN variant = 4 THEN -1 - example_id ELSE example_id END AS example_id FROM corpus) p
ON e.example_id = p.example_id"""))
def e09(t: Tables) -> DataFrame:
    """Variant-4 predictions carry a wrong id: both sides of each such pair are flagged."""
    pairs = spread_pairs(t)
    wrong = F.when(F.col("variant") == 4, -1 - F.col("example_id")).otherwise(F.col("example_id"))
    predictions = pairs.select(wrong.alias("example_id"), F.col("candidate").alias("code"))
    return E.pair_by_id(pairs.select("example_id", "code"), predictions, on_mismatch="flag").select(
        "example_id", "unmatched"
    )


@query("e10_pair_by_position", with_pairs("""
SELECT ordinal, example_id, md5(code) AS code, md5(candidate) AS candidate FROM (
  SELECT *, row_number() OVER (ORDER BY example_id) - 1 AS ordinal FROM corpus)"""))
def e10(t: Tables) -> DataFrame:
    pairs = spread_pairs(t)
    predictions = dense_ordinal(pairs.select("example_id", "candidate"), "example_id").select(
        "ordinal", F.col("candidate").alias("code")
    )
    examples = pairs.select("example_id", "code")
    return E.pair_by_position(examples, predictions, "example_id", ()).select(
        "ordinal", "example_id", F.md5("code").alias("code"), F.md5("candidate").alias("candidate")
    )


@query("e11_per_example", with_scores(f"""
SELECT example_id, description, round(bleu, {DIGITS}) AS bleu, unigram_precision, exact_match, operation_coverage,
  structural_similarity FROM scores"""))
def e11(t: Tables) -> DataFrame:
    return _rounded(E.evaluate(spread_pairs(t)), "bleu")


@query("e12_self_baseline", with_pairs("""
SELECT round(avg(CASE WHEN n >= 4 THEN 1 WHEN n = 0 THEN 0 ELSE pow(0.1, (4 - n) / 4) END), 9) AS bleu,
  1::DOUBLE AS exact_match, 1::DOUBLE AS operation_coverage, 1::DOUBLE AS structural_similarity
FROM (SELECT len(words) AS n FROM corpus)"""))
def e12(t: Tables) -> DataFrame:
    """A copy scores 1 everywhere, but BLEU gives texts of n < 4 tokens only 0.1^((4-n)/4)."""
    return _rounded(E.aggregate(E.evaluate(E.self_baseline(spread_pairs(t)))), *E.METRICS)


@query("e13_report", with_scores("""
SELECT 'means' AS part, 0::BIGINT AS place, 'all examples' AS subject, measure, printf('%.4f', score) AS score FROM (
  SELECT unnest(['bleu', 'exact_match', 'operation_coverage', 'structural_similarity']) AS measure,
    unnest([avg(bleu), avg(exact_match::INTEGER), avg(operation_coverage), avg(structural_similarity)]) AS score FROM scores)
UNION ALL
SELECT 'examples', place, substr(description, 1, 60) || '...', unnest(['bleu', 'exact_match', 'operation_coverage', 'structural_similarity']),
  printf('%.4f', unnest([bleu, exact_match::INTEGER, operation_coverage, structural_similarity]))
FROM (SELECT *, row_number() OVER (ORDER BY example_id) AS place FROM scores)"""))
def e13(t: Tables) -> DataFrame:
    return E.report(stored(E.evaluate(spread_pairs(t)), "results"))


def _two_approaches(t: Tables) -> DataFrame:
    """The same examples twice: candidates as they are, and the reference itself."""
    pairs = spread_pairs(t)
    first = E.evaluate(pairs).withColumn("approach", F.lit("rag"))
    second = E.evaluate(E.self_baseline(pairs)).withColumn("approach", F.lit("finetune"))
    return first.unionByName(second)


@query("e14_compare_approaches", with_scores(f"""
SELECT metric, round(score, {DIGITS}) AS rag, round(best, {DIGITS}) AS finetune, round(best - score, {DIGITS}) AS delta
FROM (
  SELECT 'bleu' AS metric, avg(bleu) AS score, (SELECT avg(CASE WHEN len(r) >= 4 THEN 1 WHEN len(r) = 0 THEN 0
    ELSE pow(0.1, (4 - len(r)) / 4) END) FROM parts) AS best FROM scores
  UNION ALL SELECT 'exact_match', avg(exact_match::INTEGER), 1 FROM scores
  UNION ALL SELECT 'operation_coverage', avg(operation_coverage), 1 FROM scores
  UNION ALL SELECT 'structural_similarity', avg(structural_similarity), 1 FROM scores)"""))
def e14(t: Tables) -> DataFrame:
    return _rounded(E.compare_approaches(_two_approaches(t), "rag", "finetune"), "rag", "finetune", "delta")


@query("e15_quality_gate", with_scores(f"""
SELECT {_MEANS_SQL}, avg(operation_coverage) > 0.85 AS passed FROM scores"""))
def e15(t: Tables) -> DataFrame:
    return _rounded(E.quality_gate(E.aggregate(E.evaluate(spread_pairs(t)))), *E.METRICS)


@query("e16_promotion", with_scores(f"""
SELECT round(avg(operation_coverage), {DIGITS}) AS current_score, 1::DOUBLE AS challenger_score,
  avg(operation_coverage) < 1 AS promote FROM scores"""))
def e16(t: Tables) -> DataFrame:
    pairs = spread_pairs(t)
    current = E.aggregate(E.evaluate(pairs))
    challenger = E.aggregate(E.evaluate(E.self_baseline(pairs)))
    return _rounded(E.promotion_check(current, challenger), "current_score", "challenger_score")
