import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("n", "ck", "keys", "copy", "x", "fh", "h", "f", "keep_id", "size", "rate", "runs", "part", "node", "score", "ids", "decoded", "half", "y", "spans")],
])


def prose(seed: int, n: int) -> str:
    """n words of an invented language."""
    r = random.Random(seed)
    return " ".join("".join(r.choice(("th", "an", "or", "is", "mo", "ke", "lu", "ra")) for _ in range(r.randint(1, 4))) for _ in range(n))


LONG = prose(1, 30_000)

#: Nulls in every column, empty and blank texts, a very long one, ties, copies, near copies, repeated rows.
TEXTS = [
    (1, prose(2, 120)), (2, prose(2, 120)), (3, prose(2, 120) + " "), (4, prose(2, 119) + "  changed"), (5, prose(3, 60) + "\n" + prose(2, 120)),
    (6, None), (7, ""), (8, " \n\t"), (9, "one"), (10, "one"), (11, "two words"), (12, LONG), (13, LONG + " end"), (14, "x" * 50_000),
    (15, "né à l'été 日本 😀\x00  \x1c  ok"), (16, prose(5, 40)), (16, prose(5, 40)), (17, prose(6, 40)), (17, prose(7, 40)), (None, prose(8, 50)), (None, None),
    (18, "la la la " * 60), (19, prose(9, 36)), (20, prose(9, 36)),
]


def documents(spark, texts):
    rows = [(i, t, None if k % 5 == 0 else ("en", "de")[k % 2], None if k % 7 == 3 else f"s{k % 3}", None) + ("extra",) * (len(DOCS) - 5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("edge")
    documents(spark, TEXTS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(1, 21)] + [(3, None, None), (None, 1, 1), (99, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    nan, inf = float("nan"), float("inf")
    vectors = [
        (5, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.95, 0.2, 0.0]), (4, [0.0, 1.0, 0.0]), (6, None), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [nan, 0.0, 1.0]),
        (10, [inf, 0.0, 0.0]), (11, []), (12, [2.0]), (13, [1e30, 1e29, 0.0]), (13, [1e30, 1e29, 0.0]), (None, [1.0, 0.0, 0.0]), (1, [0.9, 0.435889894354, 0.0]),
    ]
    spark.createDataFrame([(i, v, "x", 3) for i, v in vectors], "vec_id long, embedding array<float>, label string, copies int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, edge, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{edge}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
