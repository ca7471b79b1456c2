"""Queries on texts, keys, filters and vectors, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import text as T, vectors as V
from weftline.operators import corpus, sequence, vocab
from weftline.plans import sql
from weftline.plans.registry import Registry
from weftline.sources.tables import parse_vectors, table

R = Registry()


@R.add("scan_documents", "SELECT doc_id, source AS shop, lang AS category, n_chars, length(text) AS n_text FROM documents")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("shop"), F.col("lang").alias("category"), "n_chars", F.length("text").cast("long").alias("n_text"))


@R.add("embedding_parse", "SELECT 'w' || vec_id AS word, len(embedding)::INT AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def embedding_parse(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as text lines, twice with the wrong copy first and broken lines between, parsed again."""
    e = table(spark, d, "embeddings")
    word = F.concat(F.lit("w"), F.col("vec_id").cast("string"))
    line = F.concat_ws(" ", word, F.array_join(F.col("embedding").cast("array<string>"), " "))
    old = F.concat_ws(" ", word, F.array_join(F.transform("embedding", lambda x: F.lit("0")), " "))
    lines = e.select(F.explode(F.array(
        F.struct((F.col("vec_id") * 3).alias("line_no"), old.alias("value")), F.struct((F.col("vec_id") * 3 + 1).alias("line_no"), line.alias("value")),
        F.struct((F.col("vec_id") * 3 + 2).alias("line_no"), F.concat(word, F.lit(" 0.5 x")).alias("value")),
    )).alias("l")).select("l.*")
    parsed = parse_vectors(lines, 64)
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return parsed.select("word", F.size("vec").alias("dim"), F.round(total, 5).alias("total"))


@R.add("page_fields", r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading,
       len(regexp_extract_all(html, '<li>'))::INT AS n_items, array_to_string(regexp_extract_all(html, 'href="([^"]*)"', 1), ' ') AS links
FROM pages""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"),
        F.size(F.regexp_extract_all("html", F.lit("(<li>)"))).alias("n_items"), F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"')), " ").alias("links"),
    )


@R.add("incremental_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_anti(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no label has been made for yet."""
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@R.add("urls_wide", "SELECT page_id, " + ", ".join(f"coalesce(l[{i}], '') AS url_{i}" for i in range(1, 9)) + """
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages) WHERE len(l) > 0""")
def urls_wide(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"')).alias("l")).where(F.size("l") > 0)
    return links.select("page_id", *[F.coalesce(F.get("l", F.lit(i)), F.lit("")).alias(f"url_{i + 1}") for i in range(8)])


@R.add("filter_nonempty", "SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND text <> ''")
def filter_nonempty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "lang")


@R.add("filter_blocklist", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src7') AND lang NOT IN ('es')")
def filter_blocklist(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(~F.col("source").isin("src0", "src7") & ~F.col("lang").isin("es")).select("doc_id", "source")


@R.add("filter_suffix_range", r"""
SELECT c_custkey, c_name FROM (SELECT *, try_cast(regexp_extract(c_name, '#([0-9]+)$', 1) AS INT) AS k FROM customer)
WHERE k IS NOT NULL AND k NOT IN (SELECT unnest(range(20, 60)) UNION SELECT unnest(range(100, 120)))""")
def filter_suffix_range(spark: SparkSession, d: str) -> DataFrame:
    k = F.regexp_extract("c_name", "#([0-9]+)$", 1).try_cast("int")
    return table(spark, d, "customer").where(k.isNotNull() & ~k.between(20, 59) & ~k.between(100, 119)).select("c_custkey", "c_name")


@R.add("filter_isin", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_isin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@R.add("topk", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 10")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "n_chars").limit(10)


@R.add("recode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' ELSE o_orderstatus END AS status FROM orders")
def recode(spark: SparkSession, d: str) -> DataFrame:
    names = {"F": "finished", "O": "open", "P": "partial"}
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")).replace(names, subset=["status"])


@R.add("recode_conditional", """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN (CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END)
                       WHEN p_type = 'STANDARD' AND p_size > 40 THEN 'not really true' ELSE p_type END AS flag FROM part""")
def recode_conditional(spark: SparkSession, d: str) -> DataFrame:
    economy = F.when(F.col("p_size") > 25, "true").otherwise("false")
    flag = F.when(F.col("p_type") == "ECONOMY", economy).when((F.col("p_type") == "STANDARD") & (F.col("p_size") > 40), "not really true").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", flag.alias("flag"))


@R.add("json_path", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@R.add("sample_every_n", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE (r - 1) % 50 = 0")
def sample_every_n(spark: SparkSession, d: str) -> DataFrame:
    return corpus.every_nth(table(spark, d, "documents").select("doc_id"), 50, "doc_id")


@R.add("clean_text", f"SELECT doc_id, {sql.clean('text')} AS clean_text FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean(F.col("text")).alias("clean_text"))


@R.add("clean_pages", f"SELECT page_id, {sql.clean('html')} AS clean_text FROM pages")
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.clean(F.col("html")).alias("clean_text"))


@R.add("tokenize", f"SELECT doc_id, 'startseq ' || array_to_string({sql.tokens('text')}, ' ') || ' endseq' AS words FROM documents WHERE len({sql.tokens('text')}) > 0 UNION ALL SELECT doc_id, 'startseq endseq' FROM documents WHERE len({sql.tokens('text')}) = 0")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.wrapped(T.tokens(F.col("text"))), " ").alias("words"))


@R.add("tokenize_sc", f"SELECT doc_id, array_to_string({sql.tokens('text', 1, ())}, ' ') AS words FROM documents")
def tokenize_sc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("text"), 1, ()), " ").alias("words"))


@R.add("parse_filename", r"""
WITH f AS (SELECT doc_id, source || '__' || lang || '_' || doc_id || '_' || (n_chars % 13) || '.jpg' AS name FROM documents),
p AS (SELECT *, list_filter(string_split(name, '_'), lambda x: x <> '') AS l FROM f)
SELECT name, array_to_string(list_slice(l, 1, len(l) - 1), '_') AS item_key, try_cast(regexp_extract(l[len(l)], '^([0-9]+)\.', 1) AS INT) AS image_no FROM p""")
def parse_filename(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("source", F.lit("__"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit("_"), (F.col("n_chars") % 13).cast("string"), F.lit(".jpg"))
    names = table(spark, d, "documents").select(name.alias("name"))
    key, number = T.file_key(F.col("name"))
    return names.select("name", key.alias("item_key"), number.alias("image_no"))


@R.add("url_canonical", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@R.add("url_param", "SELECT page_id, CASE WHEN regexp_extract(url, '[?&]page=([^&#]{1,3})', 1) = '' THEN 'NF__' ELSE regexp_extract(url, '[?&]page=([^&#]{1,3})', 1) END AS page_no FROM pages")
def url_param(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.url_parameter(F.col("url"), "page", 3, "NF__").alias("page_no"))


@R.add("build_key", "SELECT event_id, translate(concat_ws('_', 'EV', coalesce(event_type, 'None'), coalesce(json_extract_string(props, '$.color'), 'None')), '?/', '') AS key FROM events")
def build_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.joined_key(F.lit("EV"), F.col("event_type"), F.get_json_object("props", "$.color")).alias("key"))


@R.add("split_flatten", r"""
SELECT page_id, list_filter(list_transform(flatten(list_transform(string_split(html, '<br>'), lambda x: string_split(x, chr(10)))),
       lambda x: replace(regexp_replace(x, '<[^>]*>', '', 'g'), ',', '')), lambda x: x <> '' AND x <> '"') AS lines FROM pages""")
def split_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.listed(F.col("html")).alias("lines"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    talk = table(spark, d, "conversations").where("role = 'assistant'")
    return talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.tokens(F.col("text")).alias("w"))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return vocab.encode(a, "id", "w", vocab.index(a, "id", "w", 2))


@R.add("freq_rank_index", f"""
WITH {sql.ANSWERS}
SELECT word, n, row_number() OVER (ORDER BY n DESC, f) AS ix
FROM (SELECT word, count(*) AS n, min({{'id': id, 'pos': pos}}) AS f FROM places GROUP BY word)""")
def freq_rank_index(spark: SparkSession, d: str) -> DataFrame:
    return vocab.index_by_frequency(_answers(spark, d), "id", "w")


@R.add("pad_pre", f"WITH {sql.ENCODED} SELECT id, list_concat(list_resize([]::BIGINT[], greatest(0, 70 - len(seq)), 0), list_slice(seq, greatest(1, len(seq) - 69), len(seq))) AS seq FROM encoded")
def pad_pre(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("id", T.pad(F.col("seq"), 70, left=True).alias("seq"))


@R.add("pad_post", f"WITH {sql.ENCODED} SELECT id, list_concat(list_slice(seq, 1, 70), list_resize([]::BIGINT[], greatest(0, 70 - len(seq)), 0)) AS seq FROM encoded")
def pad_post(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("id", T.pad(F.col("seq"), 70, left=False).alias("seq"))


@R.add("next_word_pairs", f"""
WITH {sql.ENCODED}
SELECT id, j::INT AS j, list_concat(list_resize([]::BIGINT[], greatest(0, 20 - j), 0), list_slice(seq, greatest(1, j - 19), j)) AS prefix, seq[j + 1] AS target
FROM encoded, unnest(range(1, len(seq))) AS g(j)""")
def next_word_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.next_words(_encoded(spark, d), "id", "seq", 20)


@R.add("shifted_pairs", f"""
WITH {sql.ENCODED},
s AS (SELECT id, list_slice(list_slice(seq, 1, len(seq) - 1), 1, 30) AS a, list_slice(list_slice(seq, 2, len(seq)), 1, 30) AS b FROM encoded WHERE len(seq) > 1)
SELECT id, list_concat(a, list_resize([]::BIGINT[], 30 - len(a), 0)) AS input, list_concat(b, list_resize([]::BIGINT[], 30 - len(b), 0)) AS output FROM s""")
def shifted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs and outputs of exactly 30 words, longer lists cut there: the length is the operator's own parameter."""
    return sequence.shifted(_encoded(spark, d), "id", "seq", 30)


@R.add("one_hot", "SELECT vec_id, list_transform(range(0, 10), lambda i: (i = label)::INT) AS hot FROM embeddings")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.one_hot(F.col("label"), 10).alias("hot"))


@R.add("attribute_vector", """
WITH a AS (SELECT DISTINCT source AS item, 'lang_' || lang AS attr FROM documents),
ix AS (SELECT attr, row_number() OVER (ORDER BY attr) AS ix FROM (SELECT DISTINCT attr FROM a)),
n AS (SELECT count(*) AS n FROM ix)
SELECT item, list_concat(list_resize([]::BIGINT[], (SELECT n FROM n) - len(l), 0), l) AS attrs
FROM (SELECT item, list(ix ORDER BY attr) AS l FROM a JOIN ix USING (attr) GROUP BY item)""")
def attribute_vector(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of an item as sorted numbers, zeros before them up to the size of the dictionary."""
    a = table(spark, d, "documents").select(F.col("source").alias("item"), F.concat(F.lit("lang_"), "lang").alias("word")).distinct()
    ix = vocab.number_rows(a.select("word").distinct(), "word", name="ix")
    n = ix.count()
    lists = a.join(ix, "word").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("word", "ix"))).alias("l"))
    return lists.select("item", T.pad(F.col("l.ix"), n, left=True).alias("attrs"))


@R.add("attribute_index", "SELECT attr, row_number() OVER (ORDER BY attr) - 1 AS ix FROM (SELECT DISTINCT lang || '_' || source AS attr FROM documents)")
def attribute_index(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select(F.concat_ws("_", "lang", "source").alias("attr")).distinct()
    return vocab.number_rows(names, "attr", name="ix").select("attr", (F.col("ix") - 1).alias("ix"))


@R.add("vector_scale", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / 255.0, 8)) AS v FROM embeddings")
def vector_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.scaled(F.col("embedding"), 255.0), lambda x: V.rounded(x, 8)).alias("v"))


@R.add("vector_mean", "SELECT label, i::INT AS i, round(avg(embedding[i + 1]::DOUBLE), 6) AS mean FROM embeddings, range(0, 64) AS g(i) GROUP BY ALL")
def vector_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean of each component within a label."""
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return cells.groupBy("label", "i").agg(V.rounded(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@R.add("vector_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS ix FROM embeddings")
def vector_argmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.first_max(F.col("embedding")).cast("int").alias("ix"))


@R.add("build_map", """
SELECT user_id, event_type || '_' || user_id AS attr, round(max(value), 4) AS score FROM events GROUP BY ALL""")
def build_map(spark: SparkSession, d: str) -> DataFrame:
    """Scores of an item as a map from type and attribute, opened again for comparison."""
    best = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    pairs = best.groupBy("user_id").agg(F.collect_list(F.struct(F.concat_ws("_", "event_type", F.col("user_id").cast("string")).alias("k"), "v")).alias("l"))
    maps = pairs.select("user_id", F.map_from_entries("l").alias("m"))
    return maps.select("user_id", F.explode("m").alias("attr", "score")).withColumn("score", F.round("score", 4))
