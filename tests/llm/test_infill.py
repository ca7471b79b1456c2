"""Fill-in-middle: the checkpoint index against a plain scan, forms and round trips."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import infill
from .conftest import TEXTS, documents, prose

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.mark.parametrize("every,chunk", [(1, 1), (3, 5), (4, 64), (infill.EVERY, infill.CHUNK)])
def test_index(every, chunk):
    r = random.Random(every)
    texts = [t or "" for _, t in TEXTS if len(t or "") < 5000] + ["".join(r.choice(" \tab é😀\n\x1c") for _ in range(r.randint(0, 60))) for _ in range(150)]
    if every > 10:
        texts += [prose(4, 20_000), "x" * 200_000, " " * 200_000, " é" * 70_000 + " "]
    for text in texts:
        units, index = UNIT.findall(text), infill.Index(text.encode(), every, chunk)
        assert index.n == len(units) and index.units == list(range(0, len(units) + 1, every)) == index.units
        assert len(index.units) == len(index.bytes) == len(index.points)
        for unit in {0, 1, every, len(units) // 2, len(units) - 1, len(units)} & set(range(len(units) + 1)):
            before = "".join(units[:unit])
            assert index.offset(unit) == (len(before.encode()), len(before))


def test_forms_and_round_trip(spark):
    marked = [(900, "a <P> b"), (901, "a<S>b c"), (902, "<M>"), (903, "<P <S <M >"), (904, "x < y> <"), (905, None), (906, ""), (None, "ends with <S"), (907, "P> begins"), (908, "  ")]
    docs = documents(spark, [(i, prose(i, i % 90)) for i in range(400)] + marked)
    made = infill.fill_in_middle(docs, rate=100, spm=50)
    rows = made.withColumn("restored", infill.restore(F.col("output"), F.col("form"))).collect()
    assert len(rows) == 410 and all(r["restored"] == r["text"] for r in rows)
    form = {r["doc_id"]: r["form"] for r in rows}
    assert all(form[i] == "plain" for i in (900, 901, 902, 905, 906, 0)) and all(form[i] != "plain" for i in (903, 904, 907, 908, 1))
    assert {"spm", "psm"} <= set(form.values())
    for r in rows:
        if r["form"] != "plain":
            a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            p, m, s = r["text"][:a], r["text"][a:b], r["text"][b:]
            assert r["output"] == (f"<P>{p}<S>{s}<M>{m}" if r["form"] == "psm" else f"<S>{s}<P>{p}<M>{m}")
        else:
            assert r["output"] == r["text"] and r["prefix_chars"] is None and r["middle_chars"] is None


def test_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))
    counts = {r[0]: r[1] for r in infill.fill_in_middle(docs).groupBy("form").count().collect()}
    assert abs(counts["plain"] - 2000) < 160 and abs(counts["spm"] - 1600) < 160
    assert infill.fill_in_middle(docs, rate=0).where("form <> 'plain'").isEmpty()
    assert infill.fill_in_middle(docs, seed=7).exceptAll(infill.fill_in_middle(docs)).count() > 2000
