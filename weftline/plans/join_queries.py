"""Queries on joins, splits, samples, sets and vocabularies, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftline.functions import text as T
from weftline.operators import corpus, vocab
from weftline.plans import sql
from weftline.plans.lineage import number_rows
from weftline.plans.registry import Registry
from weftline.sources.tables import table
from weftline.plans.text_queries import _answers, _encoded

R = Registry()


@R.add("join_inner_parsed_key", r"""
SELECT s_name, o_orderkey FROM orders JOIN supplier ON try_cast(regexp_extract(s_name, '#([0-9]+)$', 1) AS BIGINT) = o_custkey""")
def join_inner_parsed_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows joined on a key that is parsed from a name; names without one, and misses, go."""
    key = F.regexp_extract("s_name", "#([0-9]+)$", 1).try_cast("long")
    names = table(spark, d, "supplier").select("s_name", key.alias("k"))
    return table(spark, d, "orders").join(names, F.col("o_custkey") == F.col("k")).select("s_name", "o_orderkey")


@R.add("partition_tag", """
SELECT doc_id, coalesce(v, t, r) AS part
FROM (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 'VAL' END) AS v, max(CASE WHEN quality = 0 THEN 'TEST' END) AS t, max(CASE WHEN quality = 1 THEN 'TRAIN' END) AS r
      FROM documents JOIN labels USING (doc_id) GROUP BY doc_id)
WHERE coalesce(v, t, r) IS NOT NULL""")
def partition_tag(spark: SparkSession, d: str) -> DataFrame:
    """The first of VAL, TEST and TRAIN whose list has the document; others go."""
    labels = table(spark, d, "labels")
    members = {"VAL": labels.where("toxic = 1").select("doc_id"), "TEST": labels.where("quality = 0").select("doc_id"), "TRAIN": labels.where("quality = 1").select("doc_id")}
    return corpus.tagged(table(spark, d, "documents").select("doc_id"), "doc_id", members).where("part is not null")


@R.add("label_by_membership", """
SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents WHERE lang = 'de') THEN 'de' WHEN text IN (SELECT text FROM documents WHERE source = 'src1') THEN 'src1' END AS label
FROM documents""")
def label_by_membership(spark: SparkSession, d: str) -> DataFrame:
    """The label of the first list that holds the text; a miss keeps its row, with null."""
    docs = table(spark, d, "documents")
    members = {"de": docs.where("lang = 'de'").select("text"), "src1": docs.where("source = 'src1'").select("text")}
    return corpus.tagged(docs.select("doc_id", "text"), "text", members, "label").select("doc_id", "label")


@R.add("embedding_left_default", """
SELECT doc_id, len(v)::INT AS dim, round(list_sum(list_transform(v, lambda x: abs(x::DOUBLE))), 5) AS size
FROM (SELECT doc_id, coalesce(embedding, list_resize([]::FLOAT[], 64, 0)) AS v FROM documents LEFT JOIN embeddings ON vec_id = doc_id)""")
def embedding_left_default(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec"))
    words = table(spark, d, "documents").select(F.col("doc_id").alias("ix"), F.col("doc_id").cast("string").alias("word"))
    rows = vocab.matrix(words, vectors, 64)
    size = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return rows.select(F.col("ix").alias("doc_id"), F.size("vec").alias("dim"), F.round(size, 5).alias("size"))


@R.add("encode_tokens", f"WITH {sql.ENCODED} SELECT id, seq FROM encoded")
def encode_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d)


@R.add("decode_tokens", f"""
WITH {sql.ENCODED}
SELECT a.id, coalesce(string_agg(p.word, ' ' ORDER BY p.pos) FILTER (v.ix IS NOT NULL), '') AS words
FROM answers a LEFT JOIN places p USING (id) LEFT JOIN vocab v USING (word) GROUP BY a.id""")
def decode_tokens(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    known = vocab.index(a, "id", "w", 2)
    return vocab.decode(vocab.encode(a, "id", "w", known), "id", "seq", known)


@R.add("join_prefix_key", "SELECT event_id, n_name FROM events JOIN (SELECT n_name, substr(n_name, 8) AS k FROM nation) ON substr(user_id::VARCHAR, 1, 2) = k")
def join_prefix_key(spark: SparkSession, d: str) -> DataFrame:
    """Many rows to one on the first characters of a name."""
    names = table(spark, d, "nation").select("n_name", F.substring("n_name", 8, 99).alias("k"))
    return table(spark, d, "events").join(names, F.substring(F.col("user_id").cast("string"), 1, 2) == F.col("k")).select("event_id", "n_name")


@R.add("join_fallback_key", """
WITH c AS (SELECT substr(source, 1, 4) AS k, count(*) AS n FROM documents GROUP BY 1)
SELECT doc_id, coalesce(a.k, b.k) AS config, coalesce(a.n, b.n) AS n
FROM documents LEFT JOIN c a ON source = a.k LEFT JOIN c b ON a.k IS NULL AND substr(source, 1, length(source) - 1) = b.k
WHERE coalesce(a.k, b.k) IS NOT NULL""")
def join_fallback_key(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    known = docs.groupBy(F.substring("source", 1, 4).alias("config")).agg(F.count("*").alias("n"))
    shorter = F.expr("substring(source, 1, length(source) - 1)")
    return corpus.with_fallback(docs, known, "source", "config", shorter).select("doc_id", "config", "n")


@R.add("anti_seen", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark)")
def anti_seen(spark: SparkSession, d: str) -> DataFrame:
    """Texts meet by a 128-bit hash, so that whole texts are not join keys."""
    key = F.md5(F.col("text").cast("binary"))
    seen = table(spark, d, "benchmark").select(key.alias("k"))
    return table(spark, d, "documents").select("doc_id", key.alias("k")).join(seen, "k", "left_anti").where("k is not null").select("doc_id")


@R.add("join_allowlist", """
WITH a(source, allowed) AS (VALUES ('src1', ['en', 'de']), ('src2', ['fr']), ('src3', ['es', 'en', 'fr']))
SELECT doc_id FROM documents d JOIN a ON d.source = a.source AND list_contains(a.allowed, d.lang)""")
def join_allowlist(spark: SparkSession, d: str) -> DataFrame:
    """Allowed categories are always lists; a plain string never matches by substring."""
    rows = [("src1", ["en", "de"]), ("src2", ["fr"]), ("src3", ["es", "en", "fr"])]
    allowed = spark.createDataFrame(rows, "source string, allowed array<string>").select("source", F.explode("allowed").alias("lang"))
    return table(spark, d, "documents").join(F.broadcast(allowed), ["source", "lang"]).select("doc_id")


@R.add("assign_ids", """
WITH n AS (SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id))::VARCHAR AS r FROM documents)
SELECT doc_id, 'XX_' || CASE WHEN length(r) < 6 THEN lpad(r, 6, '0') ELSE r END AS new_id FROM n""")
def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus.with_ids(table(spark, d, "documents").select("doc_id", "source"), "XX", "source", "doc_id").select("doc_id", "new_id")


@R.add("train_val_test", f"WITH {sql.SPLIT} SELECT doc_id, part FROM split")
def train_val_test(spark: SparkSession, d: str) -> DataFrame:
    return corpus.split_parts(table(spark, d, "documents").select("doc_id"), "doc_id")


@R.add("sample_k", "SELECT doc_id FROM documents ORDER BY md5('0|' || doc_id), doc_id LIMIT 100")
def sample_k(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sample_k(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@R.add("batch_assign", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents QUALIFY batch < (SELECT count(*) // 32 FROM documents)")
def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    return corpus.batches_of(table(spark, d, "documents").select("doc_id"), 32, "doc_id", whole=True)


@R.add("batch_assign_all", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents")
def batch_assign_all(spark: SparkSession, d: str) -> DataFrame:
    return corpus.batches_of(table(spark, d, "documents").select("doc_id"), 32, "doc_id")


@R.add("stratified_sample", """
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS c, count(*) OVER () AS n FROM documents)
SELECT lang, doc_id, CASE WHEN k <= floor(c * 25 / n) THEN 'TEST' ELSE 'TRAIN' END AS part
FROM r WHERE k <= floor(c * 25 / n) + CASE WHEN n <= 125 THEN n ELSE floor(c * 100 / n) END""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return corpus.stratified_sample(table(spark, d, "documents"), "lang", "doc_id", 100, 25)


@R.add("union_all", "SELECT doc_id AS id, text, source FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return docs.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), allowMissingColumns=True)


@R.add("distinct_keys", "SELECT DISTINCT source, md5(text) AS text_md5 FROM documents")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("text_md5")).distinct()


@R.add("distinct_ordered", "SELECT split_part(url, '?', 1) AS url, min(page_id) AS page_id FROM pages GROUP BY 1")
def distinct_ordered(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))
    return corpus.first_seen(pages, "url", "page_id")


@R.add("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@R.add("argmax_per_group", "SELECT user_id, value, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id DESC) = 1")
def argmax_per_group(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "value", "event_id", "event_type")
    return corpus.best_of(events, "user_id", "value", "event_id")


@R.add("vocab_counts", f"""
WITH {sql.SPLIT}
SELECT word, count(*) AS n FROM (SELECT unnest({sql.tokens('text')}) AS word FROM split WHERE part = 'TRAIN') GROUP BY word HAVING count(*) >= 5""")
def vocab_counts(spark: SparkSession, d: str) -> DataFrame:
    """Words of the training part that occur at least five times."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    parts = corpus.split_parts(docs.select("doc_id"), "doc_id").where("part = 'TRAIN'").select("doc_id")
    words = docs.join(parts, "doc_id", "left_semi").select(T.tokens(F.col("text")).alias("w"))
    return vocab.counts(words, "w", 5)


@R.add("vocab_index", f"WITH {sql.ANSWERS} SELECT word, n, ix FROM vocab")
def vocab_index(spark: SparkSession, d: str) -> DataFrame:
    return vocab.index(_answers(spark, d), "id", "w", 2)


@R.add("vocab_size", "SELECT count(DISTINCT w) AS size FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''")
def vocab_size(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens between single spaces; empty ones do not count."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ", -1)).alias("w")).where("w <> ''")
    return words.agg(F.countDistinct("w").alias("size"))


@R.add("config_grid", """
SELECT webshop, e AS embedding, x AS extractor, a AS architecture, o AS dropout, CASE a WHEN 'merge' THEN 15 WHEN 'brownlee' THEN 50 ELSE 30 END AS epochs,
       CASE a WHEN 'brownlee' THEN 8 ELSE 32 END AS batch_size
FROM (SELECT DISTINCT source AS webshop FROM documents WHERE source IS NOT NULL), unnest(['glove', 'fasttext']) t(e), unnest(['incv3', 'resnet50', 'finetuned']) u(x),
     unnest(['merge', 'attention', 'parinject', 'brownlee']) v(a), unnest(['true', 'false']) w(o)
WHERE NOT (a = 'attention' AND o = 'true')""")
def config_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid of parameters for each shop that has documents."""
    # fixed values of the grid
    lists = {"embedding": ["glove", "fasttext"], "extractor": ["incv3", "resnet50", "finetuned"], "architecture": ["merge", "attention", "parinject", "brownlee"], "dropout": ["true", "false"]}
    grid = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("webshop")).distinct()
    for name in lists:
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, lists[name]))))
    grid = grid.where("NOT (architecture = 'attention' AND dropout = 'true')")
    epochs = F.when(F.col("architecture") == "merge", 15).when(F.col("architecture") == "brownlee", 50).otherwise(30)
    return grid.withColumn("epochs", epochs).withColumn("batch_size", F.when(F.col("architecture") == "brownlee", 8).otherwise(32))


@R.add("schedule_filter", """
WITH s AS (SELECT event_type AS config, row_number() OVER (PARTITION BY event_type ORDER BY ts::DATE)::INT AS epoch, round(avg(value), 6) AS cur FROM events GROUP BY event_type, ts::DATE)
SELECT config, epoch, cur FROM s QUALIFY (epoch - 1) % 4 = 0 OR epoch = 1 OR epoch = max(epoch) OVER (PARTITION BY config)""")
def schedule_filter(spark: SparkSession, d: str) -> DataFrame:
    """The epochs of each series after which a training validates: every fourth, the first and the last."""
    days = table(spark, d, "events").groupBy(F.col("event_type").alias("config"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("cur"))
    by_config = Window.partitionBy("config")  # a row for each day
    epochs = days.withColumn("epoch", F.row_number().over(by_config.orderBy("day"))).withColumn("last", F.max("epoch").over(by_config))
    due = ((F.col("epoch") - 1) % 4 == 0) | (F.col("epoch") == 1) | (F.col("epoch") == F.col("last"))
    return epochs.where(due).select("config", "epoch", "cur")


@R.add("early_stop", """
WITH s AS (SELECT event_type AS config, date_diff('day', DATE '2024-01-01', ts::DATE) AS step, round(avg(value), 6) AS cur FROM events GROUP BY ALL),
l AS (SELECT *, lag(cur, 1) OVER w AS p1, lag(cur, 2) OVER w AS p2 FROM s WINDOW w AS (PARTITION BY config ORDER BY step))
SELECT config, min(step)::INT AS stop_step FROM l WHERE cur <= 0.9 * p1 OR (p2 IS NOT NULL AND cur <= p1 AND cur <= p2) GROUP BY config""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """The first step whose metric is at most 0.9 times the last, or no better than the last two."""
    step = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    series = table(spark, d, "events").groupBy(F.col("event_type").alias("config"), step.alias("step")).agg(F.round(F.avg("value"), 6).alias("cur"))
    w = Window.partitionBy("config").orderBy("step")
    lagged = series.select("config", "step", "cur", F.lag("cur", 1).over(w).alias("p1"), F.lag("cur", 2).over(w).alias("p2"))
    stop = (F.col("cur") <= 0.9 * F.col("p1")) | (F.col("p2").isNotNull() & (F.col("cur") <= F.col("p1")) & (F.col("cur") <= F.col("p2")))
    return lagged.where(stop).groupBy("config").agg(F.min("step").alias("stop_step"))


@R.add("beam_step", """
WITH h AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS a FROM events)
SELECT user_id, place::INT AS place, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM h WHERE a <= 3) WHERE place <= 3""")
def beam_step(spark: SparkSession, d: str) -> DataFrame:
    """The three best extensions of each hypothesis, then the three best of each input."""
    events = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    hypothesis = events.withColumn("h", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    best = corpus.top_within(hypothesis, "h", 3, F.desc("value"), F.col("event_id")).drop("place")
    return corpus.top_within(best, "user_id", 3, F.desc("value"), F.col("event_id")).select("user_id", "place", "event_type", "event_id")


@R.add("running_ids", "SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) AS n FROM documents")
def running_ids(spark: SparkSession, d: str) -> DataFrame:
    return number_rows(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "n")
