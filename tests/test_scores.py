import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators import evaluate as E
from weftline.operators.ngrams import token_scores


def plain_bleu(reference, candidate, epsilon=0.1):
    """The published formula, spelled out."""
    r, c = reference.split(), candidate.split()
    if not c or not set(r) & set(c):
        return 0.0
    total = 0.0
    for n in range(1, 5):
        grams = [Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) for w in (r, c)]
        hits = sum(min(grams[0][g], k) for g, k in grams[1].items())
        total += math.log((hits or epsilon) / max(1, len(c) - n + 1))
    return (1 if len(c) > len(r) else math.exp(1 - len(r) / len(c))) * math.exp(total / 4)


def plain_unigram(reference, candidate):
    words = candidate.split()
    return sum(w in set(reference.split()) for w in words) / len(words) if words else 0.0


CASES = [
    ("a b c d e", "a b c d e"), ("a b c", "a b c"), ("a b", "c d"), ("a b", ""), ("", "a"), ("", ""),
    ("a b c d e f", "a b c d"), ("a b c d", "a b c d e f"), ("a a a b", "a a a a a"), ("a b a b a b", "b a b a"),
]


def scores(spark, cases):
    df = spark.createDataFrame(
        [(i, r, c) for i, (r, c) in enumerate(cases)], "example_id bigint, code string, candidate string"
    )
    return {r.example_id: r for r in token_scores(df).collect()}


def check(spark, cases):
    got = scores(spark, cases)
    assert len(got) == len(cases)
    for i, (r, c) in enumerate(cases):
        assert got[i].bleu == pytest.approx(plain_bleu(r, c), abs=1e-12), (r, c)
        assert got[i].unigram_precision == pytest.approx(plain_unigram(r, c), abs=1e-12), (r, c)


def test_token_scores(spark):
    check(spark, CASES)
    got = scores(spark, CASES)
    assert got[0].bleu == pytest.approx(1.0) and got[1].bleu == pytest.approx(0.1 ** 0.25)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("ab \n", max_size=40), st.text("ab \n", max_size=40)), min_size=1, max_size=30))
def test_token_scores_on_random_pairs(spark, cases):
    check(spark, cases)


def test_scores_are_a_projection(spark):
    df = spark.createDataFrame([(1, "a", "b")], "example_id bigint, code string, candidate string")
    for scored in (token_scores(df), E.evaluate(df, keep=())):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan") == 1


def test_pairs_that_share_an_id_are_scored_apart(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (1, "a b c d e", "x"), (2, "a b c d e", None)],
                               "example_id bigint, code string, candidate string")
    rows = E.evaluate(df, keep=()).collect()
    assert sorted(r.bleu for r in rows) == [0.0, 0.0, pytest.approx(1.0)]
    assert E.aggregate(E.evaluate(df, keep=())).first().exact_match == pytest.approx(1 / 3)


def pairs(spark):
    return spark.createDataFrame(
        [(1, "one", "df.select(a) and more words"), (2, "two", "x.filter(b) or so it goes"), (3, "three", "y")],
        "example_id bigint, description string, code string",
    )


def test_self_baseline_is_perfect(spark):
    results = E.evaluate(E.self_baseline(pairs(spark)))
    means = E.aggregate(results).first()
    assert means.exact_match == means.operation_coverage == means.structural_similarity == 1.0
    assert 0 < means.bleu < 1  # the one-word text


def test_no_rows_give_zeros(spark):
    empty = E.evaluate(E.self_baseline(pairs(spark).filter("false")))
    assert list(E.aggregate(empty).first()) == [0.0] * 4


def test_order_of_partitions_does_not_matter(spark):
    from pyspark.testing import assertDataFrameEqual

    df = pairs(spark).withColumn("candidate", F.reverse("code"))
    assertDataFrameEqual(
        E.evaluate(df.repartition(5)).orderBy("example_id"), E.evaluate(df.coalesce(1)).orderBy("example_id")
    )


def test_unmatched_ids_stop_the_job(spark):
    examples = pairs(spark)
    some = examples.filter("example_id < 3").select("example_id", "code")
    with pytest.raises(Exception, match="no partner for example 3"):
        E.aggregate(E.evaluate(E.pair_by_id(examples, some))).collect()
    extra = examples.select("example_id", "code").union(spark.sql("SELECT 9L, 'z'"))
    with pytest.raises(Exception, match="no partner for prediction 9"):
        E.pair_by_id(examples, extra).collect()
    flagged = E.pair_by_id(examples, some, on_mismatch="flag")
    assert [(r.example_id, r.unmatched) for r in flagged.filter("unmatched is not null").collect()] == [(3, "example")]


def test_gate_and_promotion(spark):
    results = E.evaluate(E.self_baseline(pairs(spark)))
    worse = results.withColumn("operation_coverage", F.lit(0.5))
    assert E.quality_gate(E.aggregate(results)).first().passed
    assert not E.quality_gate(E.aggregate(worse)).first().passed
    assert E.promotion_check(E.aggregate(worse), E.aggregate(results)).first().promote
    assert not E.promotion_check(E.aggregate(results), E.aggregate(results)).first().promote


def test_missing_scores_count_zero_in_the_mean(spark):
    from weftline.operators.evaluate import aggregate

    rows = spark.createDataFrame([(1, 1.0), (2, None)], "id long, bleu double")
    assert aggregate(rows, metrics=("bleu",)).first()["bleu"] == 0.5


def test_a_missing_candidate_scores_like_an_empty_one(spark):
    from weftline.operators.ngrams import token_scores

    pairs = spark.createDataFrame([(1, "a b c d e", None), (2, "a b c d e", "")], "example_id long, code string, candidate string")
    rows = [tuple(r)[1:] for r in token_scores(pairs, "example_id", "code", "candidate").orderBy("example_id").collect()]
    assert rows[0] == rows[1]


def test_repeated_ids_stop_the_job_or_are_flagged(spark):
    rows = lambda *ids: spark.createDataFrame([(i, f"d{i}", f"c{i}") for i in ids], "example_id long, description string, code string")
    with pytest.raises(Exception, match="repeated prediction 1"):
        E.pair_by_id(rows(1, 2), rows(1, 1, 2)).collect()
    with pytest.raises(Exception, match="repeated example 2"):
        E.pair_by_id(rows(1, 2, 2), rows(1, 2)).collect()
    with pytest.raises(Exception, match="no partner for example null"):
        E.pair_by_id(rows(1, None), rows(1)).collect()
    flagged = E.pair_by_id(rows(1, 2, 3, 3, None), rows(1, 2, 2, 3, 4, None), on_mismatch="flag").collect()
    assert sorted((str(r.example_id), str(r.description), str(r.unmatched)) for r in flagged) == [
        ("1", "d1", "None"), ("2", "d2", "repeated prediction"), ("3", "d3", "repeated example"), ("3", "d3", "repeated example"),
        ("4", "None", "prediction"), ("None", "None", "prediction"), ("None", "dNone", "example")]
