"""Ingest, dataset, statistics and request-log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import dataset as D
from weftline.operators import positions
from weftline.operators import validate as V
from weftline.operators.generate import check_requests, or_default
from weftline.plans.corpus import (
    LINES_SQL, OPS_SQL, REQUESTS_SQL, event_requests, example_pairs,
    order_lines, sql_strip, sql_tokens, with_pairs,
)
from weftline.plans.registry import Tables, query
from weftline.plans.reports import large_orders
from weftline.plans.scoring_queries import CHATML_SQL, SYSTEM
from weftline.session import scratch_path
from weftline.sources import catalog, jsonl
from weftline.streaming import outcomes as O
from weftline.streaming.requests import read_request_stream

# -- files ----------------------------------------------------------------------------------------


def _export_examples(t: Tables) -> str:
    """Write the conversation corpus as JSON lines in the reader's format."""
    path = scratch_path(t.spark, "examples")
    example_pairs(t).select(
        "description", F.col("code").alias("pyspark_code"), "tables", "operations", "complexity"
    ).write.json(path)
    return path


@query("s01_line_numbers", """
SELECT count(*) AS n_lines, count(*) FILTER (doc_id % 3 = 0) AS n_blank, true AS dense FROM documents""")
def s01(t: Tables) -> DataFrame:
    """Write one line per document (a third of them blank) and read them back numbered."""
    path = scratch_path(t.spark, "lines")
    # One source row per line: JSON quoting keeps the line breaks of a text inside its line.
    line = F.when(F.col("doc_id") % 3 == 0, F.lit("  \t")).otherwise(F.to_json(F.struct("doc_id", "text")))
    t.documents.select(line.alias("value")).write.text(path)
    per_file = jsonl.read_lines(t.spark, path).groupBy("path").agg(
        F.count("*").alias("n"), F.min("line_num").alias("first"), F.max("line_num").alias("last"),
        F.sum("line_num").alias("total"), F.count_if(F.regexp_like("value", F.lit(r"\A\s*\z"))).alias("blank"),
    )
    numbered = (F.col("first") == 1) & (F.col("last") == F.col("n")) & (
        F.col("total") * 2 == F.col("n") * (F.col("n") + 1)
    )
    return per_file.agg(
        F.sum("n").alias("n_lines"), F.sum("blank").alias("n_blank"), F.min(numbered).alias("dense")
    )


@query("s02_missing_path", "SELECT conv_id, 'File not found' AS outcome FROM conversations GROUP BY 1")
def s02(t: Tables) -> DataFrame:
    try:
        jsonl.read_lines(t.spark, scratch_path(t.spark, "absent"))
        outcome = "found"
    except FileNotFoundError as exc:
        outcome = str(exc).split(":")[0]
    return t.conversations.select("conv_id", F.lit(outcome).alias("outcome")).distinct()




def _sql_text_field(field: str) -> str:
    return (f"CASE WHEN json_type(j, '$.{field}') IS NULL THEN '{field}: missing'"
            f" WHEN json_type(j, '$.{field}') <> 'VARCHAR' THEN '{field}: not a string' END")


def _sql_list_field(field: str) -> str:
    return (f"CASE WHEN json_type(j, '$.{field}') IS NOT NULL AND (json_type(j, '$.{field}') <> 'ARRAY' OR len("
            f"list_filter(json_extract(j, '$.{field}[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0)"
            f" THEN '{field}: not a list of strings' END")


CHECKED_SQL = f"""
{LINES_SQL},
stripped AS (SELECT line_num, {sql_strip('value')} AS raw FROM lines),
typed AS (
  SELECT *, CASE WHEN json_valid(raw) AND raw[1] = '{{' THEN raw::JSON END AS j FROM stripped WHERE raw <> ''),
checked AS (
  SELECT *, concat_ws('; ', {_sql_text_field('description')}, {_sql_text_field('pyspark_code')},
    {_sql_list_field('tables')}, {_sql_list_field('operations')},
    CASE WHEN json_type(j, '$.complexity') <> 'VARCHAR' THEN 'complexity: not a string' END) AS problems
  FROM typed)
"""


@query("s03_validated_records", f"""
WITH {CHECKED_SQL}
SELECT line_num, j->>'$.description' AS description, j->>'$.pyspark_code' AS code,
  array_to_string(coalesce(j->>'$.tables[*]', []), ',') AS tables, coalesce(j->>'$.complexity', 'medium') AS complexity
FROM checked WHERE j IS NOT NULL AND problems = ''""")
def s03(t: Tables) -> DataFrame:
    good = V.split_checked(V.check_examples(order_lines(t))).good
    return good.select("line_num", "description", "code", F.array_join("tables", ",").alias("tables"), "complexity")


@query("s04_quarantine", f"""
WITH {CHECKED_SQL}
SELECT line_num, CASE WHEN j IS NULL THEN 'json' ELSE 'schema' END AS kind,
  CASE WHEN j IS NULL THEN 'not a JSON object' ELSE problems END AS detail, raw
FROM checked WHERE j IS NULL OR problems <> ''""")
def s04(t: Tables) -> DataFrame:
    return V.split_checked(V.check_examples(order_lines(t))).quarantine.drop("path")


@query("s05_failfast_gate", f"""
WITH {CHECKED_SQL}
SELECT count(*) AS n_errors, true AS stopped FROM checked WHERE j IS NULL OR problems <> ''""")
def s05(t: Tables) -> DataFrame:
    try:
        V.require_valid(V.check_examples(order_lines(t)))
    except V.ValidationError as exc:
        return exc.quarantine.agg(F.count("*").alias("n_errors"), F.lit(True).alias("stopped"))
    return t.spark.range(1).select(F.lit(0).alias("n_errors"), F.lit(False).alias("stopped"))


@query("s06_load_examples", with_pairs("""
SELECT description, md5(code) AS code, array_to_string(tables, ',') AS tables,
  array_to_string(operations, ',') AS operations, complexity FROM corpus"""))
def s06(t: Tables) -> DataFrame:
    examples = V.load_examples(t.spark, _export_examples(t))
    return examples.select(
        "description", F.md5("code").alias("code"), F.array_join("tables", ",").alias("tables"),
        F.array_join("operations", ",").alias("operations"), "complexity",
    )


@query("s07_read_predictions", with_pairs("""
SELECT ordinal, md5(candidate) AS code FROM (
  SELECT candidate, row_number() OVER (ORDER BY example_id) - 1 AS ordinal FROM corpus)"""))
def s07(t: Tables) -> DataFrame:
    """Predictions written in key order, read back and numbered over all part files."""
    path = scratch_path(t.spark, "predictions")
    jsonl.write_predictions(example_pairs(t).select("example_id", F.col("candidate").alias("code")), path)
    return jsonl.read_predictions(t.spark, path).select("ordinal", F.md5("code").alias("code"))


@query("s07_bad_predictions", """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS ordinal, CASE WHEN k % 5 = 0 THEN event_type END AS code,
  CASE k % 5 WHEN 1 THEN 'not a JSON object' WHEN 2 THEN 'pyspark_code: missing' WHEN 3 THEN 'pyspark_code: not a string' WHEN 4 THEN 'not a JSON object' END AS error
FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)""")
def s07_bad(t: Tables) -> DataFrame:
    """One line for each event, four of five of them broken: each is named, and none shifts the ordinal of another."""
    path = scratch_path(t.spark, "predictions")
    case = F.get_json_object("props", "$.k").cast("int") % 5
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    line = (F.when(case == 0, F.concat(F.lit('{"pyspark_code":'), quoted, F.lit("}"))).when(case == 1, F.concat(F.lit('{"pyspark_code":'), quoted))
            .when(case == 2, F.concat(F.lit('{"other":'), quoted, F.lit("}"))).when(case == 3, F.lit('{"pyspark_code":5}')).otherwise(F.lit("5")))
    t.events.orderBy("event_id").select(line.alias("value")).write.text(path)
    return jsonl.read_predictions(t.spark, path, mode="flag")


@query("s08_write_predictions", with_pairs("SELECT example_id, md5(candidate) AS code FROM corpus"))
def s08(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "predictions")
    jsonl.write_predictions(example_pairs(t).select("example_id", F.col("candidate").alias("code")), path)
    back = t.spark.read.schema("example_id bigint, pyspark_code string").json(path)
    return back.select("example_id", F.md5("pyspark_code").alias("code"))


_SPLIT_SQL = """
split AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY example_id)
    <= greatest(1, floor(count(*) OVER () * (1 - 0.1::DOUBLE))) THEN 'train' ELSE 'val' END AS split FROM corpus)"""

_CHAT_DIGEST_SQL = f"md5('system|' || {SYSTEM} || '||user|' || description || '||assistant|' || code)"


def _read_back_chats(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "chats")
    jsonl.write_chat_dataset(example_pairs(t), path, position="example_id")
    return jsonl.read_chat_dataset(t.spark, path)


@query("s09_chat_dataset", with_pairs("SELECT split, count(*) AS n FROM split GROUP BY 1", _SPLIT_SQL))
def s09(t: Tables) -> DataFrame:
    return _read_back_chats(t).groupBy("split").agg(F.count("*").alias("n"))


@query("s10_read_chat_dataset", with_pairs(f"SELECT split, {_CHAT_DIGEST_SQL} AS digest FROM split", _SPLIT_SQL))
def s10(t: Tables) -> DataFrame:
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "||")
    return _read_back_chats(t).select("split", F.md5(flat).alias("digest"))


@query("s13_catalog_scan", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def s13(t: Tables) -> DataFrame:
    catalog.register_tables(t.spark, t.folder)
    return catalog.scan(t.spark, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")


# Logical names of the tables that the reports read, as in a catalog of several schemas.
CATALOG_NAMES = {"sales.orders": "orders", "sales.lines": "lineitem", "crm.customers": "customer", "catalog.parts": "part", "web.events": "events"}


def _named_tables(t: Tables) -> None:
    catalog.create_tables(t.spark, {name: f"{t.folder}/{table}.parquet" for name, table in CATALOG_NAMES.items()})


@query("s13_report_by_name", """
SELECT p_type AS category, sum(l_extendedprice::DECIMAL(18, 2))::DOUBLE AS sales
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def s13_report(t: Tables) -> DataFrame:
    """A report over tables that are found by two-part names."""
    _named_tables(t)
    lines, parts = catalog.scan(t.spark, "sales.lines"), catalog.scan(t.spark, "catalog.parts")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("category")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sales"))


@query("s13_partitioned_table", """
SELECT strftime(o_orderdate, '%Y')::INTEGER AS year, o_orderpriority, count(*) AS orders FROM orders
WHERE year(o_orderdate) = 1997 GROUP BY ALL""")
def s13_partitioned(t: Tables) -> DataFrame:
    """Orders written by year become a partitioned table; a scan of one year reads the folder of that year."""
    place = scratch_path(t.spark, "orders-by-year")
    t.orders.withColumn("year", F.year("o_orderdate")).write.partitionBy("year").parquet(place)
    catalog.create_table(t.spark, "sales.orders_by_year", place)
    return catalog.scan(t.spark, "sales.orders_by_year").filter("year = 1997").groupBy("year", "o_orderpriority").agg(F.count("*").alias("orders"))


@query("s14_console", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def s14(t: Tables) -> DataFrame:
    """A report is shown on the console with ``show``; the rows are returned as well."""
    result = large_orders(t.orders, 300000)
    result.show()
    return result


@query("s15_load_counts", f"""
WITH {CHECKED_SQL}
SELECT count(*) FILTER (j IS NOT NULL AND problems = '') AS n_good,
  count(*) FILTER (j IS NULL OR problems <> '') AS n_bad FROM checked""")
def s15(t: Tables) -> DataFrame:
    """Counts that the job which stores the checked lines reports by the way, as columns of a row."""
    loaded = V.store_checked(V.check_examples(order_lines(t)))
    return t.spark.range(1).select(F.lit(loaded.n_good).alias("n_good"), F.lit(loaded.n_bad).alias("n_bad"))


# -- requests ----------------------------------------------------------------------------------------


@query("p01_default_fill", """
SELECT d.doc_id, array_to_string(CASE WHEN quality = 1 THEN [source, lang] ELSE [] END, ',') AS tables,
  array_to_string(CASE WHEN toxic = 0 THEN [lang] ELSE [] END, ',') AS operations,
  coalesce(CASE WHEN quality = 0 THEN 'simple' END, 'medium') AS complexity
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def p01(t: Tables) -> DataFrame:
    """Lists and complexity are absent where a document has no (matching) label."""
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.array("source", "lang")).alias("tables"),
        F.when(F.col("toxic") == 0, F.array("lang")).alias("operations"),
        F.when(F.col("quality") == 0, "simple").alias("complexity"),
    )
    return V.with_defaults(rows).select(
        "doc_id", F.array_join("tables", ",").alias("tables"), F.array_join("operations", ",").alias("operations"),
        "complexity",
    )


CHECKED_REQUESTS_SQL = f"""{REQUESTS_SQL},
filled AS (
  SELECT request_id, description, coalesce(max_tokens, 2048) AS max_tokens, coalesce(temperature, 0.1) AS temperature
  FROM requests),
judged AS (
  SELECT *, nullif(concat_ws('; ', CASE WHEN description IS NULL THEN 'description: missing' END,
    CASE WHEN NOT max_tokens BETWEEN 64 AND 4096 THEN 'max_tokens: not in 64..4096' END,
    CASE WHEN NOT temperature BETWEEN 0 AND 2 THEN 'temperature: not in 0.0..2.0' END), '') AS problem FROM filled)
"""


@query("p04_request_validation", f"WITH {CHECKED_REQUESTS_SQL} SELECT * FROM judged")
def p04(t: Tables) -> DataFrame:
    return check_requests(event_requests(t.events))


@query("p06_parameter_default", """
SELECT event_id, CASE WHEN k % 4 = 0 THEN 3 ELSE k % 4 END AS top_k, coalesce(temperature, 0.1) AS temperature
FROM (SELECT event_id, (props->>'$.k')::INTEGER AS k, CASE WHEN (props->>'$.k')::INTEGER % 3 <> 0 THEN 0::DOUBLE END
  AS temperature FROM events)""")
def p06(t: Tables) -> DataFrame:
    """0 falls back to the default for k, but is kept as a temperature."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        "event_id",
        or_default(k % 4, 3).alias("top_k"),
        F.coalesce(F.when(k % 3 != 0, F.lit(0.0)), F.lit(0.1)).alias("temperature"),
    )


# -- dataset preparation and statistics ------------------------------------------------------------------


@query("d01_positional_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id)
  <= greatest(1, floor(count(*) OVER () * (1 - 0.1::DOUBLE))) THEN 'train' ELSE 'val' END AS split FROM documents""")
def d01(t: Tables) -> DataFrame:
    return positions.positional_split(t.documents.select("doc_id"), "doc_id")


@query("d02_prepare_chat", with_pairs(f"""
SELECT split, count(*) AS n, count(DISTINCT {_CHAT_DIGEST_SQL}) AS n_distinct, min({_CHAT_DIGEST_SQL}) AS first_digest
FROM split GROUP BY 1""", _SPLIT_SQL))
def d02(t: Tables) -> DataFrame:
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("|"), m["content"])), "||")
    return _read_back_chats(t).withColumn("digest", F.md5(flat)).groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("digest").alias("n_distinct"), F.min("digest").alias("first_digest")
    )


@query("d03_set_sizes", """
SELECT 'documents' AS set_name, count(*) AS n FROM documents
UNION ALL SELECT 'conversations', count(*) FROM conversations
UNION ALL SELECT 'benchmark', count(*) FROM benchmark""")
def d03(t: Tables) -> DataFrame:
    return D.set_sizes(documents=t.documents, conversations=t.conversations, benchmark=t.benchmark)


@query("d04_complexity_histogram", with_pairs("""
SELECT complexity, count(*) AS n, min(example_id) AS first_seen FROM corpus GROUP BY 1"""))
def d04(t: Tables) -> DataFrame:
    return D.complexity_histogram(example_pairs(t), "example_id")


@query("d05_top_operations", with_pairs("""
SELECT operation, count(*) AS n FROM (
  SELECT example_id, unnest(operations) AS operation, unnest(range(len(operations))) AS pos FROM corpus)
GROUP BY 1 ORDER BY n DESC, min({'example': example_id, 'pos': pos}) LIMIT 10"""))
def d05(t: Tables) -> DataFrame:
    return D.top_operations(example_pairs(t), "example_id")


@query("d06_referenced_tables", with_pairs("""
SELECT table_name, (SELECT count(DISTINCT x) FROM (SELECT unnest(tables) AS x FROM corpus)) AS n_tables
FROM (SELECT DISTINCT unnest(tables) AS table_name FROM corpus) ORDER BY 1"""))
def d06(t: Tables) -> DataFrame:
    pairs = example_pairs(t)
    return D.referenced_tables(pairs).withColumn("n_tables", D.count_referenced_tables(pairs).scalar())


@query("d11_unknown_tables", f"""
WITH
code AS (SELECT source || '.' || lang AS table_name FROM documents)
SELECT table_name, count(*) AS uses FROM code
WHERE table_name NOT IN (SELECT DISTINCT source || '.' || lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
GROUP BY 1""")
def d11(t: Tables) -> DataFrame:
    """Code of every document against a catalog of the tables named after toxic-labelled ones."""
    name = F.concat("source", F.lit("."), "lang")
    code = t.documents.select(F.concat(F.lit('df = spark.table("'), name, F.lit('").limit(5)')).alias("code"))
    known = t.documents.join(t.labels, "doc_id").filter("toxic = 1").select(name.alias("table_name"))
    return D.unknown_tables(code, known)


@query("d11_catalog_listing", with_pairs(f"""
SELECT table_name, count(*) AS uses FROM (SELECT unnest(tables) AS table_name FROM corpus)
WHERE table_name NOT IN ({", ".join(f"'{name}'" for name in CATALOG_NAMES)}) GROUP BY 1"""))
def d11_listing(t: Tables) -> DataFrame:
    """Code that reads the tables its example names, against the listing of the session's catalog."""
    _named_tables(t)
    reads = F.transform("tables", lambda name: F.concat(F.lit('spark.table("'), name, F.lit('")')))
    code = example_pairs(t).select(F.array_join(reads, "\n").alias("code"))
    schemas = sorted({name.split(".")[0] for name in CATALOG_NAMES})
    return D.unknown_tables(code, catalog.catalog_listing(t.spark, schemas))


@query("d12_request_outcomes", """
SELECT period, requests, acceptance_rate, mean_lead_seconds, acceptance_rate > 0.6 AS on_target FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS requests,
    (count(*) FILTER (l_returnflag <> 'R'))::DOUBLE / count(*) AS acceptance_rate,
    sum(epoch_us(l_shipdate) - epoch_us(o_orderdate))::DOUBLE / count(*) / 1e6 AS mean_lead_seconds
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""")
def d12(t: Tables) -> DataFrame:
    """Order lines as the log: ordered, shipped, and accepted unless returned."""
    log = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderdate").alias("requested_at"),
        F.col("l_shipdate").alias("delivered_at"),
        (F.col("l_returnflag") != "R").alias("accepted"),
    )
    return D.request_outcomes(log, F.date_format("requested_at", "yyyy-MM"))


_OUTCOMES_SQL = """
shipped AS (SELECT l_orderkey, l_shipdate::TIMESTAMP AS delivered_at, bool_or(l_returnflag <> 'R') AS accepted FROM lineitem GROUP BY ALL),
in_time AS (
  SELECT o_orderkey, delivered_at, accepted, row_number() OVER (PARTITION BY o_orderkey ORDER BY delivered_at) AS nth
  FROM orders JOIN shipped ON o_orderkey = l_orderkey AND delivered_at BETWEEN o_orderdate::TIMESTAMP AND o_orderdate::TIMESTAMP + INTERVAL 60 DAY),
log AS (
  SELECT o_orderkey AS request_id, o_orderdate::TIMESTAMP AS requested_at, i.delivered_at, i.accepted
  FROM orders LEFT JOIN in_time i USING (o_orderkey) WHERE nth IS NULL OR nth = 1)"""
_WAIT = "60 days"


def _orders_asked(orders: DataFrame) -> DataFrame:
    """Every order as a request."""
    return orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("timestamp").alias("requested_at"))


def _lines_shipped(lineitem: DataFrame) -> DataFrame:
    """Every order line as an outcome of its order, accepted unless returned."""
    return lineitem.select(
        F.col("l_orderkey").alias("request_id"), F.col("l_shipdate").cast("timestamp").alias("delivered_at"), (F.col("l_returnflag") != "R").alias("accepted"))


@query("d12_request_log", f"""
WITH {_OUTCOMES_SQL}
SELECT strftime(requested_at, '%Y-%m') AS period, count(*) AS requests, count(delivered_at) AS delivered,
  count(*) FILTER (accepted) AS accepted, sum(epoch_us(delivered_at) - epoch_us(requested_at))::BIGINT AS lead_us FROM log GROUP BY 1""")
def d12_log(t: Tables) -> DataFrame:
    """The finished log by month: the first line shipped within 60 days of the order is its outcome, and without one it is open."""
    log = O.request_log(_orders_asked(t.orders), _lines_shipped(t.lineitem), _WAIT)
    lead = F.unix_micros("delivered_at") - F.unix_micros("requested_at")
    return log.groupBy(F.date_format("requested_at", "yyyy-MM").alias("period")).agg(
        F.count("*").alias("requests"), F.count("delivered_at").alias("delivered"), F.count_if("accepted").alias("accepted"), F.sum(lead).alias("lead_us"))


@query("d12_outcome_stream", f"""
WITH {_OUTCOMES_SQL}
SELECT strftime(requested_at, '%Y-%m') AS period, count(*) AS delivered, count(*) FILTER (accepted) AS accepted,
  sum(epoch_us(delivered_at) - epoch_us(requested_at))::BIGINT AS lead_us FROM log WHERE delivered_at IS NOT NULL GROUP BY 1""")
def d12_stream(t: Tables) -> DataFrame:
    """The same two tables as streams. Their rows are in no order of time, so the join may forget nothing within a century."""
    orders = read_request_stream(t.spark, f"{t.folder}/orders.parquet*", t.orders.schema)
    lines = read_request_stream(t.spark, f"{t.folder}/lineitem.parquet*", t.lineitem.schema)
    out = scratch_path(t.spark, "outcomes")
    O.outcome_stream(_orders_asked(orders), _lines_shipped(lines), out, scratch_path(t.spark, "progress"), _WAIT, "36500 days").awaitTermination()
    log = O.first_outcomes(O.read_log(t.spark, out))
    lead = F.unix_micros("delivered_at") - F.unix_micros("requested_at")
    return log.groupBy(F.date_format("requested_at", "yyyy-MM").alias("period")).agg(
        F.count("*").alias("delivered"), F.count_if("accepted").alias("accepted"), F.sum(lead).alias("lead_us"))


@query("d13_sequence_budget", with_pairs("""
SELECT memory_gb, max_tokens, count(*) AS examples, count(*) FILTER (length > max_tokens) AS over_budget,
  (count(*) FILTER (length > max_tokens))::DOUBLE / count(*) AS over_share
FROM lengths, (VALUES (80, 2048), (40, 2048), (24, 2048), (16, 1536), (0, 1024)) AS tiers(memory_gb, max_tokens)
GROUP BY ALL""", f"""
chats AS (
  SELECT {CHATML_SQL} AS text FROM corpus
  UNION ALL SELECT {CHATML_SQL} FROM (SELECT text AS description, text AS code FROM documents)),
lengths AS (SELECT len({sql_tokens('text')}) AS length FROM chats)"""))
def d13(t: Tables) -> DataFrame:
    """Conversation pairs plus documents (as request and code), whose lengths straddle the tiers."""
    documents = t.documents.select(F.col("text").alias("description"), F.col("text").alias("code"))
    return D.sequence_budget(example_pairs(t).select("description", "code").union(documents))


_FOUND = f"list_filter({OPS_SQL}, lambda o: contains(code, o))"


@query("d15_label_check", with_pairs(f"""
SELECT example_id, complexity,
  array_to_string(list_sort(list_filter({_FOUND}, lambda o: NOT list_contains(operations, o))), ',') AS undeclared,
  array_to_string(list_sort(list_filter(list_distinct(operations), lambda o: NOT contains(code, o))), ',') AS not_in_code
FROM corpus"""))
def d15(t: Tables) -> DataFrame:
    checked = D.label_check(example_pairs(t))
    return checked.withColumns({c: F.array_join(c, ",") for c in ("undeclared", "not_in_code")})


@query("d15_label_summary", with_pairs(f"""
SELECT complexity, count(*) AS examples,
  count(*) FILTER (len(list_filter({_FOUND}, lambda o: NOT list_contains(operations, o))) > 0) AS with_undeclared,
  count(*) FILTER (len(list_filter(operations, lambda o: NOT contains(code, o))) > 0) AS with_not_in_code
FROM corpus GROUP BY 1"""))
def d15_summary(t: Tables) -> DataFrame:
    return D.label_summary(D.label_check(example_pairs(t)))
