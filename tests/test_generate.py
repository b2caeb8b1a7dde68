import pyarrow as pa
import pytest

from weftline.operators import generate as G
from weftline.operators import retrieval as R
from weftline.streaming import requests as S

REQUEST = "request_id bigint, description string, max_tokens int, temperature double"


def test_request_rules(spark):
    rows = [(63, None), (64, None), (4096, None), (4097, None), (None, -0.1), (None, 0.0), (None, 2.0), (None, 2.1),
            (None, None)]
    df = spark.createDataFrame([(i, "d", m, t) for i, (m, t) in enumerate(rows)], REQUEST)
    got = G.check_requests(df).orderBy("request_id").collect()
    assert [r.problem is None for r in got] == [False, True, True, False, False, True, True, False, True]
    assert (got[8].max_tokens, got[8].temperature) == (2048, 0.1)
    missing = spark.createDataFrame([(1, None, 1, 9.0)], REQUEST)
    assert G.check_requests(missing).first().problem == (
        "description: missing; max_tokens: not in 64..4096; temperature: not in 0.0..2.0")


def test_zero_means_default(spark):
    df = spark.createDataFrame([(0,), (None,), (7,)], "k int")
    assert [r.k for r in df.select(G.or_default("k", 3).alias("k")).collect()] == [3, 3, 7]


def answer(system, user, temperature, max_tokens):
    if "boom" in user:
        raise RuntimeError("no answer")
    return f"Sure:\n```python\n{user.upper()} {temperature} {max_tokens}\n```"


def test_zero_shot_flow_isolates_failures(spark):
    df = spark.createDataFrame([(1, "one", 64, 0.5), (2, "boom", 64, 0.5), (3, "three", 99, 0.0)], REQUEST)
    rows = G.generate_zero_shot(df, answer, "m").orderBy("request_id").collect()
    assert [r.code for r in rows] == ["ONE 0.5 64", "", "THREE 0.0 99"]
    assert [r.error for r in rows] == [None, "RuntimeError: no answer", None]
    assert {(r.model, r.approach, tuple(r.retrieved_examples)) for r in rows} == {("m", "finetune", ())}


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(
        [(i, f"description {i}", f"code {i}", [float(i == 0), float(i == 1), float(i == 2)]) for i in range(3)],
        "example_id bigint, description string, code string, embedding array<float>",
    )


def first_code(system, user, temperature, max_tokens):
    return user.split("Code:\n", 1)[1].split("\n---")[0]


def test_retrieval_flow(spark, index):
    asked = spark.createDataFrame(
        [(10, "q", 64, 0.1, [0.9, 0.1, 0.0]), (11, "r", 64, 0.1, [0.0, 0.2, 1.0])],
        REQUEST + ", embedding array<float>")
    rows = G.generate_with_retrieval(asked, index, first_code, "m", k=2).orderBy("request_id").collect()
    assert [r.code for r in rows] == ["code 0", "code 2"]
    assert rows[1].retrieved_examples == ["description 2", "description 1"] and rows[0].approach == "rag"


def test_empty_index_gives_prompts_without_examples(spark, index):
    asked = spark.createDataFrame([(10, "q", 64, 0.1, [1.0, 0.0, 0.0])], REQUEST + ", embedding array<float>")
    row = G.few_shot_prompts(asked, index.filter("example_id < 0")).first()
    assert row.retrieved_examples == [] and row.user.endswith("Request: q\n\nCode:")


def test_syntax_share(spark):
    df = spark.createDataFrame([("a", "x = 1"), ("a", "x ="), ("b", ""), ("b", "\0")], "approach string, code string")
    assert {r.approach: (r.n, r.n_ok) for r in G.syntax_share(df).collect()} == {"a": (2, 1), "b": (2, 1)}


def test_streams(spark, index, tmp_path):
    source = str(tmp_path / "in")
    schema = REQUEST + ", embedding array<float>"
    first = spark.createDataFrame([(1, "q", None, None, [1.0, 0.0, 0.0]), (2, "r", 5, None, [0.0, 1.0, 0.0])], schema)
    first.write.parquet(source)
    out, prompts = str(tmp_path / "checked"), str(tmp_path / "prompts")

    def run_both():
        stream = S.read_request_stream(spark, source, first.schema)
        S.validate_stream(stream, out, str(tmp_path / "c1")).awaitTermination()
        S.prompt_stream(stream, index, prompts, str(tmp_path / "c2"), k=1).awaitTermination()

    run_both()
    assert {r.request_id: r.problem is None for r in spark.read.parquet(out).collect()} == {1: True, 2: False}
    assert [r.request_id for r in spark.read.parquet(prompts).collect()] == [1]
    spark.createDataFrame([(3, "s", None, None, [0.0, 0.0, 1.0])], schema).write.mode("append").parquet(source)
    run_both()  # goes on after the files already seen
    assert sorted(r.request_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    rows = {r.request_id: r.retrieved_examples for r in spark.read.parquet(prompts).collect()}
    assert rows == {1: ["description 0"], 3: ["description 2"]}


def test_stream_embeds_requests(spark, index, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "words here", None, None)], REQUEST).write.parquet(source)
    stream = S.read_request_stream(spark, source, REQUEST)
    S.prompt_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "c"),
                    embed_fn=lambda df: G.embed(df, make_model=G.hashed_words(3))).awaitTermination()
    assert len(spark.read.parquet(str(tmp_path / "out")).first().retrieved_examples) == 3


def test_null_texts_have_null_vectors(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "example_id long, description string")
    rows = {r.example_id: r.embedding for r in G.embed(df).collect()}
    assert rows[2] is None and sum(rows[1]) == 2 and sum(rows[3]) == 0
    weighted = {r.example_id: r.embedding for r in G.embed_weighted(df, dim=16).collect()}
    assert weighted[2] is None and abs(sum(x * x for x in weighted[1]) - 1) < 1e-6 and set(weighted[3]) == {0.0}
    errors = R.rejected_examples(G.embed(df)).collect()
    assert [(r.example_id, r.error) for r in errors] == [(2, "no vector")]


def test_rejected_requests_carry_their_error(spark):
    index = spark.createDataFrame([(1, "d", "c", [1.0, 0.0])], "example_id long, description string, code string, embedding array<float>")
    requests = spark.createDataFrame(
        [(1, "good", [1.0, 0.0], 100, 0.5), (2, "short", [1.0], 100, 0.5), (3, "none", None, 100, 0.5)],
        "request_id long, description string, embedding array<float>, max_tokens int, temperature double")
    prompts = {r.request_id: r for r in G.few_shot_prompts(requests, index).collect()}
    assert prompts[1].rejected is None and "good" in prompts[1].user
    assert prompts[2].user is None and "length 1, expected 2" in prompts[2].rejected and prompts[3].rejected == "no vector"
    answers = {r.request_id: r for r in G.generate_with_retrieval(requests, index, lambda *a: "```\nx\n```", "m").collect()}
    assert answers[1].code == "x" and answers[1].error is None
    assert (answers[3].code, answers[3].error) == ("", "rejected: no vector") and answers[2].error.startswith("rejected: vector length 1")


def test_a_few_prompts_at_a_time_become_strings(monkeypatch):
    """A batch of 100 prompts of 1 KB, where parts have 10 KB: slices of about ten rows, and none is lost."""
    monkeypatch.setattr(G, "PART_BYTES", 10_000)
    batch = pa.RecordBatch.from_pydict({"id": list(range(100)), "user": ["x" * 1000] * 100})
    parts = list(G._parts(batch))
    assert max(p.num_rows for p in parts) < 12 and [i for p in parts for i in p["id"].to_pylist()] == list(range(100))
    monkeypatch.setattr(G, "PART_BYTES", 1)
    assert [p.num_rows for p in G._parts(batch)] == [1] * 100 and list(G._parts(batch.slice(0, 0))) == []


def test_completion_keeps_other_columns_and_names_failures(spark, monkeypatch):
    monkeypatch.setattr(G, "PART_BYTES", 1)
    rows = [(1, "s", "a b c", 0.5, 9, None, ["x", None]), (2, "s", "a b", 0.5, 9, None, None), (3, "s", None, 0.5, 9, "no vector", []), (4, "s", "a", None, None, None, [])]
    prompts = spark.createDataFrame(rows, "request_id bigint, system string, user string, temperature double, max_tokens int, rejected string, retrieved array<string>").coalesce(1)

    def answer(system, user, temperature, max_tokens):
        return f"{len(user.split())} {temperature} {max_tokens}" if len(user.split()) != 2 else 1 / 0

    got = {r.request_id: (r.text, r.error, r.retrieved) for r in G.complete(prompts, answer).collect()}
    assert got == {
        1: ("3 0.5 9", None, ["x", None]), 2: (None, "ZeroDivisionError: division by zero", None), 3: (None, "rejected: no vector", []),
        4: (None, "ValueError: cannot convert float NaN to integer", [])}
