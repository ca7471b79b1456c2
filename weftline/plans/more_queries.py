"""Queries on smaller operators: positions, keys, links, defaults and sinks, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from weftline.functions import permute, text as T, vectors as V
from weftline.operators import corpus, enrich, retry, vocab
from weftline.plans import join_queries, sql
from weftline.plans.lineage import materialise, md5_order, number_rows, working_folder
from weftline.plans.registry import Registry
from weftline.sources.tables import good_and_bad, items, read_parts, table, write, write_parts

R = Registry()


@R.add("filter_min_size", "SELECT p_partkey FROM part WHERE p_size >= 20 AND p_retailprice >= 905")
def filter_min_size(spark: SparkSession, d: str) -> DataFrame:
    """Both measures must reach their bounds, as width and height of an image must."""
    return table(spark, d, "part").where((F.col("p_size") >= 20) & (F.col("p_retailprice") >= 905)).select("p_partkey")


@R.add("row_positions", "SELECT p FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE lang = 'de' AND source = 'src1'")
def row_positions(spark: SparkSession, d: str) -> DataFrame:
    """0-based places of the rows that meet all conditions."""
    numbered = number_rows(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return numbered.where((F.col("lang") == "de") & (F.col("source") == "src1")).select((F.col("n") - 1).alias("p"))


@R.add("join_default_list", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN [0] ELSE [quality, toxic] END AS attrs FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_default_list(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of each item; an item without any gets the list of one zero."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("k"), F.array("quality", "toxic").alias("a"))
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(labels, F.col("doc_id") == F.col("k"), "left").select("doc_id", F.coalesce("a", F.array(F.lit(0))).alias("attrs"))


@R.add("path_parts", "SELECT page_id, list_extract(string_split(split_part(url, '?', 1), '/'), -1) AS name, list_extract(string_split(split_part(url, '?', 1), '/'), -2) AS parent FROM pages")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    path = T.canonical_url(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.path_part(path, 1).alias("name"), T.path_part(path, 2).alias("parent"))


@R.add("label_after", "SELECT c_custkey, split_part(c_name, '#', 2) AS label, split_part(c_mktsegment, ': ', 2) AS missing FROM customer")
def label_after(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.after(F.col("c_name"), "#").alias("label"), T.after(F.col("c_mktsegment"), ": ").alias("missing"))


@R.add("variant_links", "SELECT page_id, code, split_part(url, '?', 1) || '?color=' || code AS link FROM pages, unnest(['001', '410', '900']) AS c(code)")
def variant_links(spark: SparkSession, d: str) -> DataFrame:
    codes = F.explode(F.array(*map(F.lit, ("001", "410", "900")))).alias("code")
    return table(spark, d, "pages").select("page_id", "url", codes).select("page_id", "code", T.variant_link(F.col("url"), F.col("code")).alias("link"))


@R.add("shuffle_epoch", "SELECT doc_id, row_number() OVER (ORDER BY md5('3|' || doc_id), doc_id) AS place FROM documents")
def shuffle_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The place of each row in the order of an epoch."""
    docs = table(spark, d, "documents").select("doc_id").withColumn("o", md5_order(3, "doc_id"))
    return number_rows(docs, "o", "doc_id", name="place").select("doc_id", "place")


@R.add("shop_index", "SELECT source AS word, row_number() OVER (ORDER BY min(doc_id)) AS ix FROM documents GROUP BY source")
def shop_index(spark: SparkSession, d: str) -> DataFrame:
    """Names numbered by first occurrence."""
    rows = table(spark, d, "documents").select("doc_id", F.array("source").alias("w"))
    return vocab.index(rows, "doc_id", "w").select("word", "ix")


@R.add("class_index", "SELECT lang, dense_rank() OVER (ORDER BY lang) - 1 AS ix FROM (SELECT DISTINCT lang FROM documents)")
def class_index(spark: SparkSession, d: str) -> DataFrame:
    """Classes numbered from 0 by name."""
    langs = table(spark, d, "documents").select("lang").distinct()
    return number_rows(langs, "lang").select("lang", (F.col("n") - 1).alias("ix"))


@R.add("reverse_ids", """
SELECT new_id, doc_id AS old_id
FROM (SELECT doc_id, 'XX_' || lpad((row_number() OVER (ORDER BY source, doc_id))::VARCHAR, 6, '0') AS new_id FROM documents)
JOIN labels USING (doc_id)""")
def reverse_ids(spark: SparkSession, d: str) -> DataFrame:
    """From new ids back to old ones, for the labelled items."""
    ids = corpus.with_ids(table(spark, d, "documents").select("doc_id", "source"), "XX", "source", "doc_id")
    return ids.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("new_id", F.col("doc_id").alias("old_id"))


@R.add("sorted_keys", "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def sorted_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = F.array_sort(F.map_keys(F.from_json("props", "map<string,string>")))
    return table(spark, d, "events").select("event_id", F.array_join(keys, ",").alias("keys"))


@R.add("last_rows", "SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 5")
def last_rows(spark: SparkSession, d: str) -> DataFrame:
    """The last five rows, as a preview of results."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.desc("doc_id")).limit(5)


@R.add("sinks_round_trip", "SELECT kind, lang, n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang), unnest(['parquet', 'json', 'csv']) AS k(kind)")
def sinks_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A report written in each format and read back."""
    report = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    root = materialise(spark.range(1)).inputFiles()[0].rpartition("/")[0]
    out = None
    for kind in ("parquet", "json", "csv"):
        write(report, f"{root}-{kind}", kind)
        reader = spark.read.schema("lang string, n bigint")
        read = reader.csv(f"{root}-{kind}", header=True) if kind == "csv" else getattr(reader, kind)(f"{root}-{kind}")
        read = read.select(F.lit(kind).alias("kind"), "lang", "n")
        out = read if out is None else out.unionByName(read)
    return out


@R.add("corpus_vocab_pages", f"SELECT word, count(*) AS n FROM (SELECT unnest({sql.tokens(chr(39) + ' ' + chr(39) + ' || html')}) AS word FROM pages) GROUP BY word HAVING count(*) >= 10")
def corpus_vocab_pages(spark: SparkSession, d: str) -> DataFrame:
    """Words of raw pages that occur at least ten times; what is left of links goes."""
    rows = table(spark, d, "pages").select(T.tokens(F.col("html")).alias("w"))
    return vocab.counts(rows, "w", 10)


@R.add("random_config", f"""
SELECT webshop, embedding, extractor, architecture, dropout FROM ({join_queries.R.sql["config_grid"]})
QUALIFY row_number() OVER (PARTITION BY webshop ORDER BY md5('7|' || embedding || extractor || architecture || dropout)) = 1""")
def random_config(spark: SparkSession, d: str) -> DataFrame:
    """One configuration of each shop's grid at random, the same for a seed."""
    names = ("webshop", "embedding", "extractor", "architecture", "dropout")
    grid = join_queries.config_grid(spark, d).select(*names)
    order = F.min(F.struct(md5_order(7, F.concat(*names[1:])).alias("o"), *names[1:])).alias("c")
    return grid.groupBy("webshop").agg(order).select("webshop", *[f"c.{n}" for n in names[1:]])


@R.add("config_prefix", "SELECT substr(source, 1, 2) AS prefix, count(*) AS n FROM documents WHERE substr(source, 1, 2) <> 'MA' GROUP BY 1")
def config_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose first two characters are not MA, by those characters."""
    prefix = F.substring("source", 1, 2)
    return table(spark, d, "documents").where(prefix != "MA").groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))


@R.add("position_mean", """
SELECT vec_id, list_transform(range(0, 8), lambda k: round(list_avg(list_transform(range(0, len(embedding) // 8), lambda p: embedding[p * 8 + k + 1]::DOUBLE)), 6)) AS mean
FROM embeddings WHERE embedding IS NOT NULL""")
def position_mean(spark: SparkSession, d: str) -> DataFrame:
    """The mean over the positions of one item, its vector read as a grid of positions with 8 numbers each."""
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", V.position_mean(F.col("embedding"), 8, 6).alias("mean"))


@R.add("crop_box", """
WITH cells AS (
  SELECT vec_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] > 0.15::FLOAT
)
SELECT vec_id, [min(x), min(y), max(x) + 1, max(y) + 1] AS box, (max(x) + 1 - min(x)) * (max(y) + 1 - min(y)) AS area FROM cells GROUP BY vec_id""")
def crop_box(spark: SparkSession, d: str) -> DataFrame:
    """The corners (x_min, y_min, x_max, y_max) that cut out all strong cells of a vector, read as a grid eight wide, and the area."""
    cell = F.posexplode(F.filter(F.transform("embedding", lambda v, i: F.struct((i % 8).cast("long").alias("x"), F.floor(i / 8).alias("y"), v.alias("v"))), lambda c: c["v"] > F.lit(0.15).cast("float")))
    cells = table(spark, d, "embeddings").select("vec_id", cell.alias("n", "c"))
    at = cells.groupBy("vec_id").agg(F.min("c.x").alias("x0"), F.min("c.y").alias("y0"), (F.max("c.x") + 1).alias("x1"), (F.max("c.y") + 1).alias("y1"))
    return at.select("vec_id", F.array("x0", "y0", "x1", "y1").alias("box"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


@R.add("best_step", """
WITH s AS (SELECT event_type AS config, date_diff('day', DATE '2024-01-01', ts::DATE) AS step, round(avg(value), 6) AS cur FROM events GROUP BY ALL),
l AS (SELECT *, lag(cur, 1) OVER w AS p1, lag(cur, 2) OVER w AS p2 FROM s WINDOW w AS (PARTITION BY config ORDER BY step)),
e AS (SELECT config, min(step) AS stop FROM l WHERE cur <= 0.9 * p1 OR (p2 IS NOT NULL AND cur <= p1 AND cur <= p2) GROUP BY config)
SELECT s.config, s.step::INT AS best_step, s.cur AS best FROM s LEFT JOIN e USING (config) WHERE stop IS NULL OR s.step <= stop
QUALIFY row_number() OVER (PARTITION BY s.config ORDER BY s.cur DESC, s.step) = 1""")
def best_step(spark: SparkSession, d: str) -> DataFrame:
    """The step whose weights a training run keeps: the best one up to where it stops, the earlier of equal ones."""
    step = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    series = table(spark, d, "events").groupBy(F.col("event_type").alias("config"), step.alias("step")).agg(F.round(F.avg("value"), 6).alias("cur"))
    w = Window.partitionBy("config").orderBy("step")
    lagged = series.select("*", F.lag("cur", 1).over(w).alias("p1"), F.lag("cur", 2).over(w).alias("p2"))
    stops = (F.col("cur") <= 0.9 * F.col("p1")) | (F.col("p2").isNotNull() & (F.col("cur") <= F.col("p1")) & (F.col("cur") <= F.col("p2")))
    first = F.min(F.when(stops, F.col("step"))).over(Window.partitionBy("config"))
    kept = lagged.withColumn("stop", first).where(F.col("stop").isNull() | (F.col("step") <= F.col("stop")))
    best = kept.groupBy("config").agg(F.max(F.struct("cur", (-F.col("step")).alias("s"))).alias("b"))
    return best.select("config", (-F.col("b.s")).alias("best_step"), F.col("b.cur").alias("best"))


_ARTICLE = "strpos(html, '<article>')"


@R.add("parked_failures", f"""
SELECT page_id, CASE WHEN whole THEN 1 WHEN begun THEN 2 END AS attempt, length(article) AS n, NOT begun AS parked
FROM (
  SELECT page_id, begun, whole, CASE WHEN begun THEN substr(html, a + 9, CASE WHEN whole THEN z - a - 9 ELSE length(html) END) END AS article
  FROM (SELECT *, a > 0 AS begun, a > 0 AND z > a AS whole FROM (SELECT page_id, html, {_ARTICLE} AS a, strpos(html, '</article>') AS z FROM pages))
)""")
def parked_failures(spark: SparkSession, d: str) -> DataFrame:
    """The article of each page: whole at the first attempt, up to the page's end where it breaks off at the second;
    pages without one are parked."""
    begun, ended = F.instr("html", "<article>"), F.instr("html", "</article>")

    def whole(rows: DataFrame) -> DataFrame:
        good = (begun > 0) & (ended > begun)
        text = F.substring("html", begun + 9, ended - begun - 9)
        return rows.withColumn("result", F.when(good, text)).withColumn("error", F.when(~good, "the article does not end"))

    def to_the_end(rows: DataFrame) -> DataFrame:
        text = F.substring("html", begun + 9, F.length("html"))
        return rows.withColumn("result", F.when(begun > 0, text)).withColumn("error", F.when(begun == 0, "no article"))

    done, parked = retry.with_retries(table(spark, d, "pages").select("page_id", "html"), whole, to_the_end)
    done = done.select("page_id", "attempt", F.length("result").cast("long").alias("n"), F.lit(False).alias("parked"))
    return done.unionByName(parked.select("page_id", F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("long").alias("n"), F.lit(True).alias("parked")))


@R.add("enriched_events", "SELECT event_id, event_type AS category, CASE WHEN month(ts) = 1 THEN 'first' ELSE 'second' END AS run, (props->>'k')::BIGINT AS k FROM events")
def enriched_events(spark: SparkSession, d: str) -> DataFrame:
    """What the properties of each event say, asked category by category in two runs; the second, over all events, asks
    only about those that the first did not have."""
    events = table(spark, d, "events")
    ask = lambda rows: rows.withColumn("said", F.from_json("props", "k bigint"))
    root = working_folder(spark)
    for run, rows in (("first", events.where(F.month("ts") == 1)), ("second", events)):
        enrich.enrich(rows, "event_id", "event_type", ask, F.col("said.k"), root, run)
    found = enrich.enriched(spark, root, "event_id bigint, answer bigint")
    return found.select("event_id", F.col("__category").alias("category"), F.col("__run").alias("run"), F.col("answer").alias("k"))


@R.add("parts_pruned", f"""
WITH {sql.SPLIT.strip()}, n AS (SELECT part, count(*) AS n FROM split GROUP BY part)
SELECT doc_id, part, lang FROM split WHERE part IN (SELECT part FROM n WHERE n < (SELECT avg(n) FROM n))""")
def parts_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the parts that are smaller than the mean, read from folders found by their names. The join prunes
    the folders of the other parts when it runs."""
    docs = corpus.split_parts(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    path = working_folder(spark)
    write_parts(docs, path, "part")
    laid_out = read_parts(spark, path)
    sizes = materialise(laid_out.groupBy("part").agg(F.count("*").alias("n")))
    wanted = sizes.where(F.col("n") < sizes.agg(F.avg("n")).first()[0]).select("part")
    return laid_out.join(F.broadcast(wanted), "part").select("doc_id", "part", "lang")  # a row for each part


@R.add("epoch_order", f"""
WITH rows AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
keys AS (SELECT r, ('0x' || substr(md5('7|' || r), 1, 15))::BIGINT AS k FROM range({permute.ROUNDS}) t(r)),
all_keys AS (SELECT list(k ORDER BY r) AS ks FROM keys)
SELECT doc_id, place, place // 32 AS batch FROM (
  SELECT doc_id, list_reduce(list_prepend(i, range({permute.ROUNDS})), lambda a, r: CASE
    WHEN substr(md5('7|' || r || '|' || greatest(a, (ks[r + 1] % n - a + n) % n)), 1, 1) < '8' THEN (ks[r + 1] % n - a + n) % n ELSE a END) AS place
  FROM rows, all_keys
)""")
def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """The place and batch of each document in an epoch's order, worked out of its row number without a sort."""
    docs = number_rows(table(spark, d, "documents").select("doc_id"), "doc_id", name="i")
    n = docs.count()
    place = permute.permuted(F.col("i") - 1, n, 7) if n else F.col("i")
    return docs.select("doc_id", place.alias("place")).withColumn("batch", F.floor(F.col("place") / 32))


@R.add("items_scan", """
SELECT 'https://shop/' || page_id AS url, substr(html, 1, strpos(html, '</title>') - 1) AS description, 'shop' AS shop, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'gender=' || page_id % 3 END AS gender,
       CASE WHEN page_id % 3 = 0 THEN 'category=all' ELSE 'category=' || page_id % 5 END AS category
FROM pages WHERE html LIKE '%</html>%'""")
def items_scan(spark: SparkSession, d: str) -> DataFrame:
    """Items of two shops' folders, with and without gender, read back. Pages that break off are broken items and go to
    the side output; files of another extension are passed over."""
    page = F.col("html")
    item = F.to_json(F.struct(F.concat(F.lit("https://shop/"), F.col("page_id").cast("string")).alias("url"), F.substring(page, F.lit(1), F.instr(page, "</title>") - 1).alias("description")))
    whole = page.contains("</html>")
    rows = table(spark, d, "pages").select(
        F.when(whole, item).otherwise(F.expr("concat(left(html, 20), '{')")).alias("value"), (F.col("page_id") % 3).alias("gender"), (F.col("page_id") % 5).alias("category"),
    )
    root = working_folder(spark)
    rows.where("gender <> 0").write.partitionBy("gender", "category").text(f"{root}/shop/ANNOS")
    rows.where("gender = 0").select("value", F.lit("all").alias("category")).write.mode("append").partitionBy("category").text(f"{root}/shop/ANNOS")
    rows.select("value").write.mode("append").json(f"{root}/shop/ANNOS")  # not items: another extension
    good, _ = good_and_bad(items(spark, root, lines=True))
    return good.select("url", "description", "shop", "gender", "category")
