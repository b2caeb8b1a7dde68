"""Example corpora that Spark derives from the test tables, with equal SQL.

The tables hold prose only, so code-like texts are made from it: words of a reply take turns
as method calls, quoted literals, F-functions and plain words. Everything is computed per row
over the whole tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.metrics import OPERATIONS
from weftline.functions.text import WS, tokens
from weftline.plans.registry import Tables

# Names a corpus row may declare as its tables.
TABLE_NAMES = ("sales.orders", "crm.customers", "catalog.parts", "web.events", "finance.payments", "hr.staff")

# -- SQL building blocks ---------------------------------------------------------------------


def sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{WS}+|{WS}+\z', '', 'g')"


def sql_normalize(c: str) -> str:
    return f"regexp_replace({sql_strip(c)}, '{WS}+', ' ', 'g')"


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({sql_strip(c)}, '{WS}+'), lambda x: x <> '')"


OPS_SQL = sql_list(OPERATIONS)

# Conversation pairs: a user turn and the assistant turn after it.
PAIRS_SQL = f"""
said AS (
  SELECT u.conv_id, u.turn, u.conv_id * 4294967296 + u.turn AS example_id, (u.conv_id + u.turn) % 5 AS variant,
    u.text AS description, {sql_tokens('a.text')} AS words
  FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
pieced AS (
  SELECT *, list_transform(words, lambda x, i: CASE (i - 1) % 5
      WHEN 0 THEN '.' || {OPS_SQL}[(length(x) + i - 1) % 32 + 1] || '('
      WHEN 1 THEN '"' || x || '")' WHEN 2 THEN x WHEN 3 THEN 'F.' || x ELSE chr(10) || x END) AS pieces,
    list_transform(list_filter(words, lambda x, i: (i - 1) % 10 = 0),
      lambda x: {sql_list(TABLE_NAMES)}[length(x) % 6 + 1]) AS tables,
    list_transform(list_filter(words, lambda x, i: (i - 1) % 4 = 0),
      lambda x, i: {OPS_SQL}[(length(x) * i) % 32 + 1]) AS operations,
    CASE WHEN len(words) < 40 THEN 'simple' WHEN len(words) < 120 THEN 'medium' ELSE 'complex' END AS complexity
  FROM said),
coded AS (SELECT *, array_to_string(pieces, ' ') AS code FROM pieced),
scored AS (
  SELECT *, CASE variant
    WHEN 0 THEN chr(28) || ' ' || replace(code, ' ', chr(160) || chr(9))
    WHEN 1 THEN array_to_string(list_filter(pieces, lambda x, i: (i - 1 + example_id) % 7 <> 0), ' ')
    WHEN 2 THEN array_to_string(list_filter(pieces, lambda x, i: i % 2 = 1), ' ')
    WHEN 3 THEN array_to_string(pieces[1:len(pieces) // 2], ' ')
    ELSE CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'x y' END END AS candidate
  FROM coded),
corpus AS (
  SELECT *, CASE variant
    WHEN 0 THEN 'Sure.' || chr(10) || '```python' || chr(10) || candidate || chr(10) || '```' || chr(10)
      || 'Or:' || chr(10) || '```' || chr(10) || 'pass' || chr(10) || '```'
    WHEN 1 THEN '``` ' || chr(10) || candidate || '```'
    WHEN 2 THEN '```python' || chr(10) || candidate
    WHEN 3 THEN chr(133) || candidate || chr(8232)
    ELSE '```' || chr(10) || '```' END AS raw_output
  FROM scored)
"""


def with_pairs(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([PAIRS_SQL, *ctes])}\n{select}"


def example_pairs(t: Tables) -> DataFrame:
    """Conversation pairs as examples with a candidate of varying quality.

    (conv_id, turn) is unique, so the self join has no hot key even when one conversation is huge.
    """
    said = t.conversations
    asked = said.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("description"))
    answered = said.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), tokens("text").alias("words")
    )
    ops = F.array(*[F.lit(w) for w in OPERATIONS])
    names = F.array(*[F.lit(w) for w in TABLE_NAMES])

    def piece(x, i):
        word = F.element_at(ops, (F.length(x) + i) % 32 + 1)
        return (
            F.when(i % 5 == 0, F.concat(F.lit("."), word, F.lit("(")))
            .when(i % 5 == 1, F.concat(F.lit('"'), x, F.lit('")')))
            .when(i % 5 == 2, x)
            .when(i % 5 == 3, F.concat(F.lit("F."), x))
            .otherwise(F.concat(F.lit("\n"), x))
        )

    def every(n):
        return F.filter("words", lambda x, i: i % n == 0)

    variant, pieces = F.col("variant"), F.col("pieces")
    pairs = (
        asked.join(answered, ["conv_id", "turn"])
        .withColumn("example_id", F.col("conv_id") * 2**32 + F.col("turn"))
        .withColumn("variant", (F.col("conv_id") + F.col("turn")) % 5)
        .withColumn("pieces", F.transform("words", piece))
        .withColumn("tables", F.transform(every(10), lambda x: F.element_at(names, F.length(x) % 6 + 1)))
        .withColumn(
            "operations", F.transform(every(4), lambda x, i: F.element_at(ops, (F.length(x) * (i + 1)) % 32 + 1))
        )
        .withColumn(
            "complexity",
            F.when(F.size("words") < 40, "simple").when(F.size("words") < 120, "medium").otherwise("complex"),
        )
        .withColumn("code", F.array_join("pieces", " "))
    )
    kept = F.filter(pieces, lambda x, i: (i + F.col("example_id")) % 7 != 0)
    pairs = pairs.withColumn(
        "candidate",
        F.when(variant == 0, F.concat(F.lit("\x1c "), F.replace("code", F.lit(" "), F.lit("\u00a0\t"))))
        .when(variant == 1, F.array_join(kept, " "))
        .when(variant == 2, F.array_join(F.filter(pieces, lambda x, i: i % 2 == 0), " "))
        .when(variant == 3, F.array_join(F.slice(pieces, F.lit(1), F.expr("cast(size(pieces) div 2 as int)")), " "))
        .otherwise(F.when(F.col("conv_id") % 2 == 0, "").otherwise("x y")),
    )
    candidate = F.col("candidate")
    return pairs.withColumn(
        "raw_output",
        F.when(variant == 0, F.concat(F.lit("Sure.\n```python\n"), candidate, F.lit("\n```\nOr:\n```\npass\n```")))
        .when(variant == 1, F.concat(F.lit("``` \n"), candidate, F.lit("```")))
        .when(variant == 2, F.concat(F.lit("```python\n"), candidate))
        .when(variant == 3, F.concat(F.lit("\u0085"), candidate, F.lit("\u2028")))
        .otherwise("```\n```"),
    ).drop("words", "pieces")


# Embedded examples: every vector, with the document of the same number if there is one.
INDEXED_SQL = """
indexed AS (
  SELECT vec_id AS example_id, coalesce(text, '') AS description, list_transform(embedding, lambda x: x::DOUBLE) AS v,
    'spark.table("' || coalesce(source, '') || '.' || coalesce(lang, '') || '").filter(F.col("label") == ' || label || ')' AS code
  FROM embeddings LEFT JOIN documents ON vec_id = doc_id)
"""

TOP3_SQL = """
pairs AS (
  SELECT q.example_id AS query_id, q.description AS asked, i.example_id, i.description, i.code,
    list_dot_product(q.v, i.v) AS score FROM indexed q, indexed i),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 10) DESC, example_id) AS rank
  FROM pairs QUALIFY rank <= 3)
"""


def indexed_examples(t: Tables) -> DataFrame:
    """(example_id, description, code, embedding) from the vectors and their documents."""
    code = F.concat(
        F.lit('spark.table("'), F.coalesce("source", F.lit("")), F.lit("."), F.coalesce("lang", F.lit("")), F.lit('").filter(F.col("label") == '),
        F.col("label").cast("string"), F.lit(")"),
    )
    return t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id"), "left").select(
        F.col("vec_id").alias("example_id"), F.coalesce("text", F.lit("")).alias("description"), code.alias("code"), "embedding"
    )


# Requests: one per event, with parameters in and out of range.
REQUESTS_SQL = """
requests AS (
  SELECT event_id AS request_id,
    CASE WHEN k % 17 <> 3 THEN event_type || ' report for user ' || user_id END AS description,
    CASE WHEN k % 10 <> 0 THEN k * 50 END AS max_tokens,
    CASE WHEN k % 7 <> 0 THEN (k - 5) / 40.0::DOUBLE END AS temperature
  FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events))
"""


def event_requests(events: DataFrame) -> DataFrame:
    """(request_id, description, max_tokens, temperature); works on streams too."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("request_id"),
        F.when(k % 17 != 3, F.concat("event_type", F.lit(" report for user "), F.col("user_id").cast("string")))
        .alias("description"),
        F.when(k % 10 != 0, k * 50).alias("max_tokens"),
        F.when(k % 7 != 0, (k - 5) / F.lit(40.0)).alias("temperature"),
    )


# JSON lines: one per order, with a defect that depends on the customer.
_LINE_CASES = (
    '{{"description":"order {k}","pyspark_code":"df{k}","tables":["orders"],"operations":[],"complexity":"simple"}}',
    '{{"description":"order {k}","pyspark_code":""}}',
    '{{"pyspark_code":"df{k}"}}',
    '{{"description":null,"pyspark_code":"df{k}"}}',
    '{{"description":{k},"pyspark_code":"df{k}"}}',
    '{{"description":"order {k}","pyspark_code":"df{k}","tables":"orders"}}',
    '{{"description":"order {k}","pyspark_code":"df{k}","tables":["a",{k}]}}',
    '{{"description":"order {k}","pyspark_code":"df{k}","operations":["a",null]}}',
    '{{"description":"order {k}","pyspark_code":"df{k}","operations":null,"complexity":7}}',
    '{{"description":"order {k}","pyspark_code":"df{k}"',
    '{{"description":"order {k}","pyspark_code":"df{k}"}} {k}',
    '["order {k}"]',
    "{k}",
    "   ",
    '  {{"description":"order {k}","pyspark_code":"df{k}","extra":{{"x":1}},"tables":[]}}  ',
)


def _line_parts(case: str) -> list[str]:
    return case.replace("{{", "{").replace("}}", "}").split("{k}")


LINES_SQL = "lines AS (SELECT o_orderkey AS line_num, CASE o_custkey % " + str(len(_LINE_CASES)) + " " + " ".join(
    f"WHEN {n} THEN " + " || o_orderkey || ".join(f"'{p}'" for p in _line_parts(case))
    for n, case in enumerate(_LINE_CASES)
) + " END AS value FROM orders)"


def order_lines(t: Tables) -> DataFrame:
    """(path, line_num, value): JSON lines good and bad."""
    key = F.col("o_orderkey").cast("string")

    def text(case: str):
        parts = [F.lit(p) for p in _line_parts(case)]
        mixed = [parts[0]]
        for part in parts[1:]:
            mixed += [key, part]
        return F.concat(*mixed)

    which = F.col("o_custkey") % len(_LINE_CASES)
    value = F.when(which == 0, text(_LINE_CASES[0]))
    for n, case in enumerate(_LINE_CASES[1:], 1):
        value = value.when(which == n, text(case))
    return t.orders.select(F.lit("orders").alias("path"), F.col("o_orderkey").alias("line_num"), value.alias("value"))
