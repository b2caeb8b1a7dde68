"""Conversation repair, hard negatives and impact search against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm.cells import matrix, products
from weftline.llm.hard_negatives import hard_negatives
from weftline.llm.impact_search import ImpactIndex, top_products
from weftline.llm.turn_repair import HELD_BYTES, repair_reports, repaired_turns

TURNS = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(WS)
        out.append("blank" if not body.strip(WS) else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines) by trying every string of edits with up to two inserts at a place."""
    found, best = faults(rows), None
    for edits in itertools.product(*["DKR" if f not in ("blank", "duplicate") else "D" for f in found]):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * i + e for i, e in zip(inserts, [*edits, ""]))
            cost = sum({"D": 3, "K": 0, "R": 2, "I": 2}[c] for c in audit) + sum(e != "D" and f == "truncated" for e, f in zip(edits, found))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            lines, at, fits = [], iter(zip(rows, found)), True
            for e in audit:
                place = lines[-1][0] if lines else ""
                due = {"": "user", "s": "user", "u": "assistant", "a": "user"}[place]
                row = next(at)[0] if e != "I" else None
                if e == "I":
                    lines.append(due[0] + "|" + due + ":")
                elif e == "R":
                    lines.append(due[0] + "|" + due + ":" + row[1])
                elif e == "K":
                    initial = row[0][:1]
                    if not (initial == "s" and not lines) and initial != due[0]:
                        fits = False
                        break
                    lines.append(initial + "|" + ":".join(row))
            if fits and (not lines or lines[-1][0] == "a"):
                best = cost, audit, [line[2:] for line in lines]
    return best


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def test_repair_equals_trying_all_edits(spark):
    draw = random.Random(5)
    table = []
    for conv in range(120):
        for turn in range(draw.randrange(0, 5)):
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", ""])
            table.append((conv, draw.choice([turn, turn, turn, 7, None]), role, draw.choice(["a.", "b!", "c", " \n", "", "d? "])))
    got = {r.conv_id: r for r in repair_reports(spark.createDataFrame(table, TURNS).repartition(3)).collect()}
    assert set(got) == {t[0] for t in table}
    for conv, r in got.items():
        rows = order([t for t in table if t[0] == conv])
        said = [t[2:] for t in rows]
        cost, audit, lines = cheapest(said)
        assert (r.cost, r.audit) == (cost, audit), (conv, said)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found = faults(said)
        assert (r.blank, r.duplicate, r.truncated) == tuple(map(found.count, ("blank", "duplicate", "truncated")))
        initials = [s[0][:1] for s in said]
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = {t[1] for t in rows} - {None}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)


def test_repaired_turns_are_what_the_report_hashes(spark):
    table = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Well"), (1, 5, "assistant", " \t"), (None, None, None, None)]
    rows = spark.createDataFrame(table, TURNS).withColumn("place", F.lit("clash")).withColumn("fault", F.lit(1))
    turns = repaired_turns(rows).orderBy("conv_id", "place").collect()
    reports = {r.conv_id: r for r in repair_reports(rows).collect()}
    lines = [f"{t.role}:{t.text}" for t in turns if t.conv_id == 1]
    assert lines == ["system:Be brief.", "user:Hi.", "assistant:Well"] and [t.edit for t in turns if t.conv_id == 1] == ["K", "K", "R"]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == reports[1].repaired_sha256
    assert (reports[1].audit, reports[1].gaps, reports[1].duplicate, reports[1].blank) == ("KKDRD", 2, 1, 1)
    # A row without anything is one space by nobody: blank, to be deleted.
    assert (reports[None].audit, reports[None].cost, reports[None].gaps) == ("D", 3, 0)


def test_conversations_without_rows(spark):
    assert repair_reports(spark.createDataFrame([], TURNS)).count() == 0
    rows = spark.createDataFrame([(4, 1, "user", "gone.")], TURNS)
    r = repair_reports(rows, F.lit(False)).first()
    assert (r.conv_id, r.cost, r.audit, r.blank, r.repaired_sha256) == (4, 0, "", 0, hashlib.sha256(b"").hexdigest())


def test_long_conversations_spill_and_cross_batches(spark):
    """A conversation beyond what is held in memory, in batches of ten rows, is mended like a short one."""
    n = 4000
    text = "x" * (4 * HELD_BYTES // n) + "."
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.col("id").cast("string"), F.lit(text)).alias("text"))
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "10")
    try:
        r = repair_reports(rows.filter("turn <> 1001")).first()
    finally:
        spark.conf.set(key, before)
    # One answer is missing between two questions: it is put in.
    assert (r.cost, r.gaps, r.illegal) == (2, 1, 1) and r.audit == "K" * 1001 + "I" + "K" * (n - 1002)
    whole = "\n".join(("user:" if i % 2 == 0 else "assistant:") + ("" if i == 1001 else f"{i}{text}") for i in range(n))
    assert r.repaired_sha256 == hashlib.sha256(whole.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed, n=260, dims=5):
    """Small whole scores, so that there are many ties; some rows repeat an id or a vector, or cannot take part."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, dims) / 16], int(rng.integers(0, 4))) for i in range(n)]
    rows += [rows[3], rows[20], (20, rows[5][1], 1), (None, rows[7][1], 2), (None, rows[7][1], 2)]
    rows += [(1000, None, 1), (1020, [0.5, None, 0.0, 0.0, 0.0], 1), (1040, [float("nan")] * dims, 1), (1060, [float("inf")] * dims, 1), (1080, rows[9][1], None)]
    return rows + [(1100, [], 1), (1120, [0.25], 2), (1140, [0.0] * dims, 3), (1160, [9.0] * dims, 0)]


def valid(rows, scale):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            out.append((i, [int(np.floor(scale * x)) for x in v], label))
    return out


def ranked(rows, at, candidates):
    """Scores and ids of the candidates, best first."""
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = [(product(rows[at][1], rows[c][1]), rows[c][0]) for c in candidates if c != at]
    return sorted(out, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


@pytest.mark.parametrize("block_rows", [16, 1 << 14])
def test_top_products_equal_brute_force(spark, block_rows):
    rows = vectors(1)
    table = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("row", F.lit(0))
    got = sorted(tuple(r) for r in top_products(table, F.col("vec_id") % 20 == 0, k=3, block_rows=block_rows).fillna(-1).collect())
    use = valid(rows, 64)
    want = []
    for at, (i, _, _) in enumerate(use):
        if i is not None and i % 20 == 0:
            want += [(i, rank, -1 if c is None else c, s) for rank, (s, c) in enumerate(ranked(use, at, range(len(use)))[:3], 1)]
    assert got == sorted(want)


def test_top_products_of_few_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert top_products(empty, F.col("vec_id") % 20 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1)], VECTORS)
    assert [tuple(r) for r in top_products(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 32)]


def test_index_stops_on_proof(spark):
    """One row is far better than all others: few levels are needed, and few rows are left."""
    from weftline.llm.cells import Rows

    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (5000, 16)).astype(float)
    v[77] = 60
    index = ImpactIndex(Rows(np.arange(5000), np.arange(5000), np.zeros(5000, bool), v, None))
    members = index.possible(np.full(16, 9.0), None, 1)
    assert 77 in members and len(members) <= 8
    # Any query: whatever is left out scores below the k-th best.
    for q in rng.integers(-9, 10, (20, 16)).astype(float):
        members = index.possible(q, 5, 10)
        scores = v @ q
        scores[5] = -np.inf
        assert set(np.flatnonzero(scores > np.sort(scores)[-11])) <= set(members.tolist())


def test_products_are_exact_for_large_components():
    import pyarrow as pa

    a = matrix(pa.array([[2**26, 1], [3]]))
    assert a.dtype == np.int64 or products(a, a).max() == 2**52 + 1
    big = matrix(pa.array([[2**27 + 1]]))
    assert products(big, big).tolist() == [[(2**27 + 1) ** 2]]
    with pytest.raises(ArithmeticError):
        products(matrix(pa.array([[2**40]])), matrix(pa.array([[2**40]])))


@pytest.mark.parametrize("block_rows,clusters", [(16, 3), (1 << 14, 1)])
def test_hard_negatives_equal_brute_force(spark, block_rows, clusters):
    rows = vectors(2)
    table = spark.createDataFrame(rows, VECTORS).withColumn("rank", F.lit("clash")).withColumn("turn", F.lit(0))
    out = hard_negatives(table, F.col("vec_id") % 20 == 0, positives=3, negatives=4, block_rows=block_rows, clusters=clusters)
    got = sorted(tuple(r) for r in out.fillna(-1).collect())
    use = [r for r in valid(rows, 256) if r[2] is not None]
    want = []
    for at, (i, _, label) in enumerate(use):
        if i is None or i % 20:
            continue
        same = ranked(use, at, [c for c, r in enumerate(use) if r[2] == label])[:3]
        other = ranked(use, at, [c for c, r in enumerate(use) if r[2] != label])
        for p, pid in same:
            fit = [(s, c) for s, c in other if 30 * p <= 100 * s <= 90 * p][:4]
            want += [(i, -1 if pid is None else pid, rank, -1 if c is None else c, p, s) for rank, (s, c) in enumerate(fit, 1)]
    assert got == sorted(want) and len(want) > 40


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2), (2, None, 1), (3, [1.0], None)], VECTORS)
    assert hard_negatives(alone, F.col("vec_id") % 20 == 0).count() == 0
