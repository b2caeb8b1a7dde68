import os
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import validate as V
from weftline.operators.positions import dense_ordinal, positional_split
from weftline.sources import jsonl


def write(tmp_path, name, data: bytes):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


GOOD = b'{"description":"a","pyspark_code":"b"}'


def test_line_numbers_count_blank_lines_and_all_line_ends(spark, tmp_path):
    path = write(tmp_path, "x.jsonl", GOOD + b"\n\n  \n" + GOOD + b"\r\n" + GOOD + b"\r" + GOOD)
    lines = jsonl.read_lines(spark, path)
    assert [r.line_num for r in lines.orderBy("line_num").collect()] == [1, 2, 3, 4, 5, 6]
    kept = jsonl.non_blank(lines).orderBy("line_num").collect()
    assert [r.line_num for r in kept] == [1, 4, 5, 6]


@pytest.mark.parametrize("split_bytes", ["200", "4096"])
def test_line_numbers_over_many_splits_and_files(spark, tmp_path, split_bytes):
    sizes = {"a.txt": 1, "b.txt": 500, "c.txt": 0, "d.txt": 77}
    for name, n in sizes.items():
        write(tmp_path, name, b"".join(b"%s %d%s\n" % (name.encode(), i, b" x" * (i % 40)) for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = jsonl.read_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        rows = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == sum(sizes.values())
    for r in rows:
        name, number = r.value.split()[:2]
        assert os.path.basename(r.path) == name and r.line_num == int(number)


def test_missing_path(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jsonl.read_lines(spark, str(tmp_path / "none.jsonl"))


CASES = [
    ('{"description":"a","pyspark_code":"b"}', None),
    ('{"pyspark_code":"b"}', "description: missing"),
    ('{"description":null,"pyspark_code":"b"}', "description: not a string"),
    ('{"description":1,"pyspark_code":"b"}', "description: not a string"),
    ('{"description":"a","pyspark_code":"b","tables":"t"}', "tables: not a list of strings"),
    ('{"description":"a","pyspark_code":"b","tables":["t",1]}', "tables: not a list of strings"),
    ('{"description":"a","pyspark_code":"b","tables":["t",null]}', "tables: not a list of strings"),
    ('{"description":"a","pyspark_code":"b","tables":[null]}', "tables: not a list of strings"),
    ('{"description":"a","pyspark_code":"b","operations":null}', "operations: not a list of strings"),
    ('{"description":"a","pyspark_code":"b","tables":[],"operations":["x"],"complexity":"odd"}', None),
    ('{"description":"","pyspark_code":"","complexity":""}', None),
    ('{"description":"a","description":"z","pyspark_code":"b"}', None),
    ('{"description":"a","pyspark_code":"b","complexity":null}', "complexity: not a string"),
    ('{"description":"a","pyspark_code":"b","more":{"x":[1]}}', None),
    ('{"description":[1],"pyspark_code":{}}', "description: not a string; pyspark_code: not a string"),
    ('{"description":"a","pyspark_code":"b","tables":{"x":1,"x":2}}', "tables: not a list of strings"),
    ('{"description":{"x":1,"x":2},"pyspark_code":"b","complexity":{"x":1,"x":2}}', "description: not a string; complexity: not a string"),
    ('{"description":"a","pyspark_code":"b","tables":{"x":{"y":1,"y":2}}}', "not a JSON object"),
    ('{"description":"a","pyspark_code":"b","t\\u0061bles":[{"x":1,"x":2}]}', "tables: not a list of strings"),
    ('{"description":"a \\"tables\\" b","pyspark_code":"b","more":{"x":1,"x":2}}', None),
    ('["a"]', "not a JSON object"),
    ("5", "not a JSON object"),
    ("null", "not a JSON object"),
    ("{broken", "not a JSON object"),
    ('{"description":"a","pyspark_code":"b"} tail', "not a JSON object"),
    ('{"description":"a","pyspark_code":"b"}{"description":"c","pyspark_code":"d"}', "not a JSON object"),
    ('{"description":"a","pyspark_code":"b"},{"description":"c","pyspark_code":"d"}', "not a JSON object"),
    ('{"description":"a","pyspark_code":"b"}]', "not a JSON object"),
    ("{'description':'a','pyspark_code':'b'}", "not a JSON object"),
    ('{"description":"a","pyspark_code":"b",}', "not a JSON object"),
    ('{"description":"a\tb","pyspark_code":"b"}', "not a JSON object"),
    (' {"description":"\\u00e4 \\n","pyspark_code":"b"} ', None),
    ("{}", "description: missing; pyspark_code: missing"),
]


@pytest.fixture(scope="module")
def checked(spark):
    lines = spark.createDataFrame([("p", i, text) for i, (text, _) in enumerate(CASES, 1)],
                                  "path string, line_num bigint, value string")
    return V.check_examples(lines)


def test_validation(checked):
    rows = checked.orderBy("line_num").collect()
    assert [(r.line_num, r.detail) for r in rows] == [(i, d) for i, (_, d) in enumerate(CASES, 1)]
    assert {r.kind for r in rows if r.detail == "not a JSON object"} == {"json"}
    assert (rows[0].tables, rows[0].operations, rows[0].complexity) == ([], [], "medium")
    assert (rows[9].operations, rows[9].complexity, rows[10].complexity) == (["x"], "odd", "")
    assert rows[11].description == "z"
    assert rows[-2].description == "ä \n"


def test_failfast_names_lines_and_keeps_all_errors(checked):
    bad = sum(d is not None for _, d in CASES)
    with pytest.raises(V.ValidationError, match="Line 2: schema error: description: missing") as caught:
        V.require_valid(checked, shown=3)
    assert f"and {bad - 3} more" in str(caught.value)
    assert caught.value.quarantine.count() == bad
    parts = V.split_checked(checked)
    assert parts.good.count() == len(CASES) - bad == V.require_valid(checked.filter("kind is null")).count()


def test_load_modes(spark, tmp_path):
    path = write(tmp_path, "x.jsonl", GOOD + b"\n\nbad\n" + GOOD)
    parts = V.load_examples(spark, path, mode="quarantine")
    assert [r.line_num for r in parts.good.orderBy("line_num").collect()] == [1, 4]
    assert [(r.line_num, r.raw) for r in parts.quarantine.collect()] == [(3, "bad")]
    with pytest.raises(ValueError):
        V.load_examples(spark, path)


@pytest.mark.parametrize("n,train", [(0, 0), (1, 1), (2, 1), (10, 9), (17, 15), (1003, int(1003 * 0.9))])
def test_split_sizes(spark, n, train):
    marked = positional_split(spark.range(n), "id")
    assert sorted(r.id for r in marked.filter("split = 'train'").collect()) == list(range(train))
    assert marked.count() == n


@pytest.mark.parametrize("spread,width,levels", [
    ("id", 10, 3), ("id * 7919", 10, 8), ("id * id * 100003", 1000, 4), ("id * 9000000000000", 1_000_000, 3),
    ("id", 1_000_000, 1),
])
def test_ordinals_and_split_of_sparse_positions(spark, spread, width, levels):
    df = spark.range(500).select(F.expr(spread).alias("p")).repartition(7)
    rows = dense_ordinal(df, "p").collect()
    assert [r.ordinal for r in sorted(rows, key=lambda r: r.p)] == list(range(500))
    marked = positional_split(df, "p", 0.25, width=width, levels=levels).collect()
    assert [r.split for r in sorted(marked, key=lambda r: r.p)] == ["train"] * 375 + ["val"] * 125


def test_ordinals_within_files(spark):
    df = spark.createDataFrame([(f, i) for f in "ba" for i in (9, 3, 25)], "path string, line_num bigint")
    rows = dense_ordinal(df, "line_num", within=["path"]).orderBy("ordinal").collect()
    assert [(r.path, r.line_num, r.ordinal) for r in rows] == [
        ("a", 3, 0), ("a", 9, 1), ("a", 25, 2), ("b", 3, 3), ("b", 9, 4), ("b", 25, 5)]
    split = positional_split(df, "line_num", 0.5, within=["path"], width=5)
    assert {r.path for r in split.filter("split = 'train'").collect()} == {"a"}


def test_numbering_is_spread_and_keeps_wide_rows_out_of_windows(spark):
    """200,000 rows, a third of them in one group: tasks number ranges of narrow rows, and the wide ones only meet their number."""
    group = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string")))
    wide = spark.range(0, 200_000, 1, 6).select(group.alias("g"), (F.col("id") * 7).alias("p"), F.repeat(F.lit("wide"), 20).alias("text"))
    out = dense_ordinal(wide, "p", within=["g"])
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SinglePartition" not in text
    rows = out.select("g", "p", "ordinal").toPandas().sort_values(["g", "p"])
    assert rows["ordinal"].tolist() == list(range(200_000))
    numbers = re.search(r"ordinals-[0-9a-f]+", "".join(out.inputFiles())).group()
    narrow = spark.read.parquet(os.path.join(spark.conf.get("spark.checkpoint.dir"), numbers))
    tasks = [r.n for r in narrow.groupBy("_task").agg(F.count("*").alias("n")).collect()]
    assert len(tasks) == 8 and max(tasks) < 2 * 200_000 / 8 and "text" not in narrow.columns


def test_numbering_of_nothing_and_of_nulls(spark):
    assert dense_ordinal(spark.range(0), "id").collect() == []
    df = spark.createDataFrame([(None, 1), ("a", None), ("a", 5)], "g string, p long")
    assert [tuple(r) for r in dense_ordinal(df, "p", within=["g"]).orderBy("ordinal").collect()] == [(None, 1, 0), ("a", None, 1), ("a", 5, 2)]


def test_bad_predictions_are_named(spark, tmp_path):
    lines = ['{"pyspark_code":"a"}', "", "{broken", '{"other":1}', "5", '{"pyspark_code":7}', '{"pyspark_code":null}', '{"pyspark_code":""}', '{"pyspark_code":"a"} x']
    path = write(tmp_path, "p.jsonl", "\n".join(lines).encode())
    rows = jsonl.read_predictions(spark, path, mode="flag").orderBy("ordinal").collect()
    none, missing, kind = "not a JSON object", "pyspark_code: missing", "pyspark_code: not a string"
    assert [(r.ordinal, r.code, r.error) for r in rows] == [
        (0, "a", None), (1, None, none), (2, None, missing), (3, None, none), (4, None, kind), (5, None, kind), (6, "", None), (7, None, none)]
    with pytest.raises(Exception, match=r"p.jsonl, line [34567]: "):
        jsonl.read_predictions(spark, path).collect()


def test_predictions_round_trip_by_position(spark, tmp_path):
    df = spark.createDataFrame([(i, f"code {i}\n{{}}" if i % 2 else None) for i in range(40)],
                               "example_id bigint, code string")
    path = str(tmp_path / "preds")
    jsonl.write_predictions(df.repartition(5), path)
    back = jsonl.read_predictions(spark, path).orderBy("ordinal").collect()
    assert [(r.ordinal, r.code) for r in back] == [(i, f"code {i}\n{{}}" if i % 2 else "") for i in range(40)]


def test_chat_dataset_round_trip(spark, tmp_path):
    examples = spark.createDataFrame([(i, f"d{i}", f"c{i}") for i in range(17)],
                                     "line_num bigint, description string, code string")
    path = str(tmp_path / "chats")
    jsonl.write_chat_dataset(examples, path)
    rows = jsonl.read_chat_dataset(spark, path).collect()
    assert sorted((r.split, r.messages[1].content, r.messages[2].content) for r in rows) == sorted(
        ("train" if i < 15 else "val", f"d{i}", f"c{i}") for i in range(17))


def test_lines_are_parsed_once_and_counted_by_the_job_that_stores_them(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def met(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lines = spark.createDataFrame([("p", i, GOOD.decode() if i % 3 else "bad") for i in range(90)], "path string, line_num long, value string").mapInArrow(met, "path string, line_num long, value string")
    loaded = V.store_checked(V.check_examples(lines))
    assert (loaded.n_good, loaded.n_bad) == (60, 30) and loaded.good.count() == 60 and loaded.quarantine.count() == 30
    with pytest.raises(V.ValidationError) as caught:
        V.require_valid(V.check_examples(lines), shown=None)
    assert str(caught.value).count("Line ") == 30 and caught.value.quarantine.count() == 30
    assert seen.value == 2 * 90
