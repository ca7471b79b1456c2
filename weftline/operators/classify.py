"""A text classifier on hashed words, in place of the convolutional one: another model in the same data flow."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.sql import DataFrame, functions as F

from weftline.functions.text import tokens
from weftline.operators.corpus import part_of
from weftline.plans.lineage import materialise

#: Labels that a classifier may have.
MOST_LABELS = 10_000


def classify_texts(docs: DataFrame, key: str, text: str, label: str, features: int = 1 << 12) -> DataFrame:
    """(key, part, label, predicted): a logistic regression learned on the TRAIN part, applied to every row.

    Rows without a label teach nothing. Labels are numbered by name; they reach the driver, at most MOST_LABELS.
    """
    known = docs.where(F.col(label).isNotNull())
    if (n := known.select(label).distinct().limit(MOST_LABELS + 1).count()) > MOST_LABELS or not n:
        raise ValueError(f"between 1 and {MOST_LABELS} labels are needed")
    rows = docs.where(F.col(key).isNotNull()).select(key, part_of(docs, key).alias("part"), F.col(label).alias("label"), tokens(F.col(text), 1, ()).alias("w"))
    # words stay in the task that reads their text; only counts by hash are written, once for all passes of the training
    rows = materialise(HashingTF(inputCol="w", outputCol="tf", numFeatures=features).transform(rows).drop("w"))
    train = rows.where((F.col("part") == "TRAIN") & F.col("label").isNotNull())
    names = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    stages = [IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", maxIter=20, regParam=0.01)]
    model = Pipeline(stages=stages).fit(names.transform(train))
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=names.labels)
    return back.transform(model.transform(rows)).select(key, "part", "label", "predicted")
