import pytest
from pyspark.sql import functions as F

from weftline.functions import metrics as M
from weftline.functions import prompts as P
from weftline.functions import text as X


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", fn("v").alias("out")).orderBy("i").collect()]


SPACED = ["", "   ", " a  b ", "\ta\n\nb\r\nc ", " a b ", "\x1ca\x1fb", "a\u0085b", "a  b", "\u3000a",
          "one", "a\x0bb\x0cc", "no\u200bspace"]


def test_spaces_follow_python(spark):
    assert apply(spark, X.strip, SPACED) == [s.strip() for s in SPACED]
    assert apply(spark, X.tokens, SPACED) == [s.split() for s in SPACED]
    assert apply(spark, X.normalize_space, SPACED) == [" ".join(s.split()) for s in SPACED]


@pytest.mark.parametrize("text,code", [
    (" plain ", "plain"),
    ("```python\nx = 1\n```", "x = 1"),
    ("```\nx = 1\n```", "x = 1"),
    ("before\n```python\na\n```\nafter\n```python\nb\n```", "a"),
    ("```python\n```", ""),
    ("```python\nopen", "```python\nopen"),
    ("```\n\n  a\n\n  b \n```", "a\n\n  b"),
    ("```python x\ny\n```", "```python x\ny\n```"),
    ("```python  \n y```", "y"),
])
def test_extract_code(spark, text, code):
    assert apply(spark, X.extract_code, [text]) == [code]


def test_preview_counts_characters(spark):
    assert apply(spark, lambda c: X.preview(c, 3), ["äöüß", "a", "😀😀😀😀"]) == ["äöü...", "a...", "😀😀😀..."]


def test_fixed4_rounds_like_python(spark):
    values = [n / d for d in (1, 3, 7, 32, 64, 160, 800, 1600) for n in range(d + 1)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.s for r in rows.select("i", X.fixed4("v").alias("s")).orderBy("i").collect()]
    assert got == [f"{v:.4f}" for v in values]


def test_prompts(spark):
    df = spark.createDataFrame([("ask {x}", "code()")], "description string, code string").withColumn(
        "hits", F.array(F.struct(F.lit("d1").alias("description"), F.lit("c1").alias("code")),
                        F.struct(F.lit("d2").alias("description"), F.lit("{c2}").alias("code"))))
    none = F.filter("hits", lambda h: F.lit(False))
    row = df.select(
        P.chat_messages("description", "code").alias("chat"), P.chat_messages("description").alias("ask"),
        P.chatml_text("description").alias("ml"), P.few_shot_prompt("description", "hits").alias("few"),
        P.few_shot_prompt("description", none).alias("zero"),
    ).first()
    assert [m.role for m in row.chat] == ["system", "user", "assistant"]
    assert [m.role for m in row.ask] == ["system", "user"]
    assert row.ml.endswith("<|im_start|>user\nask {x}<|im_end|>\n<|im_start|>assistant\n<|im_end|>")
    assert "Request: d1\nCode:\nc1\n---\nRequest: d2\nCode:\n{c2}\n---" in row.few
    assert row.few.endswith("Request: ask {x}\n\nCode:")
    assert "---" not in row.zero and row.zero.endswith("Request: ask {x}\n\nCode:")


PAIRS = [
    ("df.select('a').filter(x)", "df.select('a')"),
    ("collect_list(x)", "col(x)"),
    ("nothing here", "also none"),
    ("", ""),
    ("", "F.sum(x)"),
    ("a  b", "a\tb"),
    ("Select", "select"),
    ("\"mixed'", "DF.x('y\nz')"),
    (".größe (1)", ".größe(2) F.naïve"),
]


def test_row_metrics(spark):
    rows = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(PAIRS)], "i int, r string, c string")
    got = rows.select(
        "i", M.exact_match("r", "c").alias("exact"), M.operation_coverage("r", "c").alias("cover"),
        M.structural_similarity("r", "c").alias("struct"), M.structural_similarity("c", "r").alias("other_way"),
        F.array_sort(M.patterns_in("c")).alias("patterns"), M.operations_in("r").alias("ops"),
    ).orderBy("i").collect()
    assert [r.exact for r in got] == [False, False, False, True, False, True, False, False, False]
    assert [r.cover for r in got][:5] == [0.5, 1 / 2, 1.0, 1.0, 1.0]
    assert got[1].ops == ["col", "collect_list"]  # substrings count
    assert [r.struct for r in got][:5] == [2 / 3, 0.0 if got[1].patterns else 1.0, 1.0, 1.0, 0.0]
    assert got[7].patterns == ["x", "y\nz"]
    assert got[8].patterns == ["größe", "naïve"]
    assert all(r.struct == r.other_way and 0 <= r.struct <= 1 for r in got)
