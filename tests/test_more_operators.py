"""CIDEr, permutations, second tries, resumable enrichment, stores in buckets and parts, against plain Python and plans."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions.permute import permuted
from weftline.operators import enrich, metrics, retry, store
from weftline.plans import queries
from weftline.sources import tables


def cider_brute(pairs):
    """{item: (CIDEr, CIDEr-D)} of (item, reference, prediction)."""
    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    items, held = {i for i, _, _ in pairs}, Counter()
    for n in range(1, 5):
        for item in items:
            held.update({g for i, ref, _ in pairs if i == item for g in grams(ref.split(), n)})
    out = {}
    for item, ref, pred in pairs:
        ref, pred, scores = ref.split(), pred.split(), [0, 0]
        for n in range(1, 5):
            weigh = lambda c: {g: k * math.log(len(items) / max(1, held[g])) for g, k in c.items()}
            a, b = weigh(grams(pred, n)), weigh(grams(ref, n))
            norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
            if norm:
                scores[0] += sum(a[g] * b.get(g, 0) for g in a) / norm
                scores[1] += sum(min(a[g], b.get(g, 0)) * b.get(g, 0) for g in a) / norm
        out.setdefault(item, []).append((2.5 * scores[0], 2.5 * scores[1] * math.exp(-((len(pred) - len(ref)) ** 2) / 72)))
    return {i: tuple(sum(x) / len(s) for x in zip(*s)) for i, s in out.items()}


def test_cider(spark):
    pairs = [
        ("a", "the red shirt is here", "the red shirt"), ("a", "a red shirt", "the red shirt"), ("b", "blue trousers with a belt", "blue trousers with a belt"), ("c", "", "x y"), ("d", "x y", ""),
        ("e", "red red red shirt", "red red red red red"), ("f", "one two three four five six", "six five four three two one"),
    ]
    rows = spark.createDataFrame([(k, i, r.split(), p.split()) for k, (i, r, p) in enumerate(pairs)], "k int, item string, ref array<string>, pred array<string>")
    got = {r["item"]: (r["cider"], r["cider_d"]) for r in metrics.cider(rows, "k", "item", "ref", "pred").collect()}
    want = cider_brute(pairs)
    assert got.keys() == want.keys()
    for item, scores in want.items():
        assert got[item] == pytest.approx(scores)
    assert got["b"] == pytest.approx((10, 10)) and got["c"] == got["d"] == (0, 0)
    assert metrics.cider(rows.limit(0), "k", "item", "ref", "pred").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), n, 3).alias("p"), permuted(F.col("id"), n, 4).alias("q"))
    rows = rows.withColumn("back", permuted(F.col("p"), n, 3, inverse=True)).collect()
    assert sorted(r["p"] for r in rows) == sorted(r["q"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)
    if n == 1000:
        assert sum(r["p"] == r["q"] for r in rows) < 10
        steps = [abs(a["p"] - b["p"]) for a, b in zip(rows, rows[1:])]
        assert 280 < sum(steps) / len(steps) < 390  # a third of n, as in a random order


def test_batches_of_an_epoch(spark):
    rows = spark.range(103).select(F.col("id").alias("i"), (F.col("id") * 2).alias("x"))
    for epoch in (0, 1):
        batches = [store.batch_of(rows, "i", 103, epoch, b, 25).collect() for b in range(5)]
        assert [len(b) for b in batches] == [25, 25, 25, 25, 3]
        assert sorted(r["i"] for b in batches for r in b) == list(range(103)) and all(r["x"] == 2 * r["i"] for b in batches for r in b)
    assert store.batch_of(rows, "i", 103, 0, 9, 25).count() == 0


def test_buckets_meet_without_shuffle(spark):
    """Words and vectors in the same buckets: the join of the query has no Exchange."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    rows = queries.QUERIES["example_store"](spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
    one = spark.createDataFrame([(None, 1), (1, 2), (1, 3)], "k long, v int")
    assert sorted(map(str, store.bucketed(one, "k", 3).collect())) == sorted(map(str, one.collect()))


def test_parts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "TRAIN"), (2, "TEST"), (3, None), (4, "TRAIN")], "id long, part string")
    tables.write_parts(rows, f"{tmp_path}/parts", "part")
    assert sorted(map(str, tables.read_parts(spark, f"{tmp_path}/parts").select("id", "part").collect())) == sorted(map(str, rows.collect()))
    plan = queries.QUERIES["parts_pruned"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_second_tries(spark):
    rows = spark.createDataFrame([(1, "5"), (2, "6 kg"), (3, "none"), (3, "none"), (4, None)], "id long, v string")
    seen = []

    def attempt(expression, error):
        def run(df):
            seen.append(df.count())
            return df.withColumn("result", F.expr(expression)).withColumn("error", F.when(F.col("result").isNull(), F.concat(F.lit(error), F.coalesce("v", F.lit("null")))))

        return run

    done, parked = retry.with_retries(rows, attempt("try_cast(v AS int)", "no number: "), attempt("try_cast(split_part(v, ' ', 1) AS int)", "no first number: "))
    assert sorted((r["id"], r["result"], r["attempt"]) for r in done.collect()) == [(1, 5, 1), (2, 6, 2)] and seen == [5, 4]
    assert sorted((r["id"], tuple(r["errors"])) for r in parked.collect()) == [(3, ("no number: none", "no first number: none"))] * 2 + [(4, ("no number: null", "no first number: null"))]
    done, parked = retry.with_retries(rows.limit(0), attempt("1", ""))
    assert done.count() == parked.count() == 0
    with pytest.raises(ValueError):
        retry.with_retries(rows.withColumn("error", F.lit(1)), attempt("1", ""))


class Stopped(Exception):
    pass


@pytest.mark.parametrize("when", ["asking", "before the manifest"])
def test_enrichment_is_stopped_and_goes_on(spark, tmp_path, when, monkeypatch):
    root, schema = f"{tmp_path}/done", "id bigint, answer int"
    items = spark.createDataFrame([(k, f"c{k % 3}", str(k) if k % 10 else "broken") for k in range(60)] + [(None, None, "7")], "id long, kind string, payload string")
    asked = []

    def ask(rows):
        asked.append(0)
        if fail and len(asked) == fail:
            raise Stopped
        return rows.withColumn("said", F.expr("try_cast(payload AS int)"))

    run = lambda items_, name: enrich.enrich(items_, "id", "kind", ask, F.col("said"), root, name, at_once=1)
    fail = 4 if when == "asking" else 0  # in the second of the four categories
    if when != "asking":
        create, calls = spark.createDataFrame, []

        def stops(*args, **kw):
            calls.append(args)
            if isinstance(args[0], list) and args[0] and args[0][0][0] == "r1" and args[0][0][1] == "c0":
                raise Stopped
            return create(*args, **kw)

        monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: stops(*a, **k))
    with pytest.raises(Stopped):
        run(items, "r1")
    monkeypatch.undo()
    fail = 0
    before = {r["category"] for r in enrich.manifest(spark, root).collect()}
    assert before == {"__null__"} and enrich.enriched(spark, root, schema).count() == 1  # what is half done does not count
    found = {(r["category"], r["rows"], r["failed"]) for r in run(items, "r1").collect()}
    assert found == {("__null__", 1, 0), ("c0", 18, 2), ("c1", 18, 2), ("c2", 18, 2)}
    rows = enrich.enriched(spark, root, schema).collect()
    assert sorted(r["answer"] for r in rows if r["id"] is not None) == [k for k in range(60) if k % 10] and len(rows) == 55
    more = items.withColumn("payload", F.when(F.col("payload") == "broken", "1").otherwise(F.col("payload"))).unionByName(spark.createDataFrame([(100, "c9", "9")], "id long, kind string, payload string"))
    found = {(r["category"], r["rows"]) for r in run(more, "r2").where("run = 'r2'").collect()}
    assert found == {("__null__", 0), ("c0", 2), ("c1", 2), ("c2", 2), ("c9", 1)}  # only what failed, and what is new
    rows = enrich.enriched(spark, root, schema).collect()
    assert sorted(str(r["id"]) for r in rows) == sorted(map(str, [None, 100, *range(60)]))


def test_lcs_bits():
    import random

    def table(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 90))] for _ in range(2))
        assert metrics._lcs(a, b, 1) == table(a, b)
