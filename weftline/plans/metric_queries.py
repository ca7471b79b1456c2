"""Queries on metrics, reports, decoders and streams, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import text as T
from weftline.operators import classify, decode, metrics
from weftline.plans import sql
from weftline.plans.lineage import materialise, number_rows, working_folder
from weftline.plans.registry import Registry
from weftline.sources.tables import table
from weftline.streaming import sections, seen

R = Registry()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    talk = table(spark, d, "conversations")
    user = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref_text"))
    answer = talk.where("role = 'assistant'").select(F.col("conv_id").alias("c"), (F.col("turn") - 1).alias("t"), F.col("text").alias("pred_text"))
    joined = user.join(answer, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")))
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return joined.select(key.alias("pair_id"), "ref_text", "pred_text", T.tokens(F.col("ref_text")).alias("ref"), T.tokens(F.col("pred_text")).alias("pred"))


def _combined(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of the conversations and, as a second set, each benchmark text with itself."""
    words = T.tokens(F.col("text"))
    own = F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("pair_id")
    more = table(spark, d, "benchmark").select(own, F.col("text").alias("ref_text"), F.col("text").alias("pred_text"), words.alias("ref"), words.alias("pred"))
    return pairs(spark, d).unionByName(more)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


@R.add("count_by_category", "SELECT lang, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY lang")
def count_by_category(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    total = docs.agg(F.count("*").alias("t"))
    return docs.groupBy("lang").agg(F.count("*").alias("n")).join(total, F.lit(True)).select("lang", "n", (F.col("n") / F.col("t")).alias("share"))


@R.add("leaderboard_mean", """
SELECT row_number() OVER (ORDER BY m DESC, l_returnflag, l_linestatus) AS place, l_returnflag, l_linestatus, round(m, 3) AS mean_price
FROM (SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS m FROM lineitem GROUP BY ALL)""")
def leaderboard_mean(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 6).alias("m"))
    ranked = number_rows(means.withColumn("o", -F.col("m")), "o", "l_returnflag", "l_linestatus", name="place")
    return ranked.select("place", "l_returnflag", "l_linestatus", F.round("m", 3).alias("mean_price"))


@R.add("group_max", "SELECT p_type, max(p_retailprice) AS best FROM part GROUP BY p_type")
def group_max(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_type").agg(F.max("p_retailprice").alias("best"))


@R.add("weighted_accuracy", "SELECT o_orderpriority, 1 - sum((o_orderstatus = 'F')::INT) / count(*) AS accuracy FROM orders GROUP BY 1")
def weighted_accuracy(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.sum((F.col("o_orderstatus") == "F").cast("long"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg((1 - wrong / F.count("*")).alias("accuracy"))


@R.add("collect_per_item", """
SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'assistant') AS predictions, arg_max(text, turn) FILTER (role = 'user') AS reference
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0""")
def collect_per_item(spark: SparkSession, d: str) -> DataFrame:
    """The predictions of an item in order, and its last reference."""
    talk = table(spark, d, "conversations")
    answers = F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text"))))
    out = talk.groupBy("conv_id").agg(answers.alias("l"), F.max(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("u"))
    return out.where(F.size("l") > 0).select("conv_id", F.col("l.text").alias("predictions"), F.col("u.text").alias("reference"))


@R.add("max_len", f"SELECT max(len({sql.tokens('text')}))::INT AS longest, round(avg(len({sql.tokens('text')})), 6) AS mean FROM documents")
def max_len(spark: SparkSession, d: str) -> DataFrame:
    size = F.size(T.tokens(F.col("text")))
    return table(spark, d, "documents").agg(F.max(size).alias("longest"), F.round(F.avg(size), 6).alias("mean"))


@R.add("bleu_components", f"WITH {sql.GRAMS} SELECT n, sum(clip)::BIGINT AS clip, sum(pred_total)::BIGINT AS total FROM overlap GROUP BY n")
def bleu_components(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bleu_components(pairs(spark, d), "pair_id", "ref", "pred")


_BLEU = """,
parts AS (SELECT n, sum(clip) AS clip, sum(pred_total) AS total FROM overlap GROUP BY n),
sizes AS (SELECT sum(len(ref)) AS r, sum(len(pred)) AS c FROM tok),
bp AS (SELECT CASE WHEN c > r THEN 1.0 WHEN c > 0 THEN exp(1 - r / c) ELSE 0.0 END AS b FROM sizes),
upto AS (
  SELECT k, CASE WHEN count(*) FILTER (clip > 0) = k THEN (SELECT b FROM bp) * exp(avg(ln(CASE WHEN clip > 0 THEN clip / total ELSE 1 END))) ELSE 0.0 END AS v
  FROM unnest([1, 2, 3, 4]) g(k) LEFT JOIN parts ON n <= k GROUP BY k
)
SELECT round(max(v) FILTER (k = 1), 6) AS bleu_1, round(max(v) FILTER (k = 2), 6) AS bleu_2, round(max(v) FILTER (k = 3), 6) AS bleu_3, round(max(v) FILTER (k = 4), 6) AS bleu_4 FROM upto"""


@R.add("bleu_corpus", f"WITH {sql.GRAMS}{_BLEU}")
def bleu_corpus(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.bleu(pairs(spark, d), "pair_id", "ref", "pred")
    return _rounded(out, *out.columns)


@R.add("cider", f"""
WITH {sql.GRAMS},
df AS (SELECT n, g, count(*) AS df FROM per_gram WHERE ref > 0 GROUP BY ALL),
w AS (SELECT pair_id, n, hyp, ref, pow(ln((SELECT count(*) FROM tok) / coalesce(df, 1)), 2) AS w FROM per_gram LEFT JOIN df USING (n, g)),
s AS (
  SELECT pair_id, n, sum(hyp * ref * w) AS dot, sum(least(hyp, ref) * ref * w) AS clip, sqrt(sum(hyp * hyp * w)) * sqrt(sum(ref * ref * w)) AS norm
  FROM w GROUP BY ALL
),
c AS (SELECT pair_id, sum(CASE WHEN norm > 0 THEN dot / norm END) * 10 / 4 AS c, sum(CASE WHEN norm > 0 THEN clip / norm END) * 10 / 4 AS d FROM s GROUP BY ALL)
SELECT pair_id, round(coalesce(c, 0), 6) AS cider, round(coalesce(d, 0) * exp(-pow(len(pred) - len(ref), 2) / 72.0), 6) AS cider_d
FROM tok LEFT JOIN c USING (pair_id)""")
def cider(spark: SparkSession, d: str) -> DataFrame:
    """CIDEr and CIDEr-D of each answer with its question as the one reference."""
    return _rounded(metrics.cider(pairs(spark, d), "pair_id", "pair_id", "ref", "pred"), "cider", "cider_d")


@R.add("bleu_combined", "WITH " + sql.GRAMS.replace("FROM pairs)", "FROM pairs UNION ALL SELECT 'b' || item_id, " + sql.tokens("text") + ", " + sql.tokens("text") + " FROM benchmark)") + _BLEU)
def bleu_combined(spark: SparkSession, d: str) -> DataFrame:
    """BLEU of the pairs of several sets together, not the mean of their scores."""
    out = metrics.bleu(_combined(spark, d), "pair_id", "ref", "pred")
    return _rounded(out, *out.columns)


@R.add("rouge_n", f"""
WITH {sql.GRAMS},
s AS (SELECT n, CASE WHEN pred_total > 0 THEN clip / pred_total ELSE 0 END AS p, CASE WHEN ref_total > 0 THEN clip / ref_total ELSE 0 END AS r FROM overlap)
SELECT n, round(sum(p) / (SELECT count(*) FROM tok), 6) AS p, round(sum(r) / (SELECT count(*) FROM tok), 6) AS r,
       round(sum(CASE WHEN p + r > 0 THEN p * r / (0.5 * p + 0.5 * r) ELSE 0 END) / (SELECT count(*) FROM tok), 6) AS f FROM s GROUP BY n""")
def rouge_n(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.rouge_n(pairs(spark, d), "pair_id", "ref", "pred"), "p", "r", "f")


def _lcs_sql(weight: float) -> str:
    """Longest common subsequences row by row: best and run hold, for each place of pred, the value and the run of
    matches that end there. A place without a match takes the best since the last match."""
    return f"""
WITH RECURSIVE {sql.PAIR_TOKENS.strip()},
lcs AS (
  SELECT pair_id, ref, pred, 0 AS i, list_transform(range(len(pred)), lambda x: 0.0::DOUBLE) AS best, list_transform(range(len(pred)), lambda x: 0::BIGINT) AS run FROM tok
  UNION ALL
  SELECT pair_id, ref, pred, i + 1,
         list_transform(range(1, len(pred) + 1), lambda j: list_max(list_slice(cand, coalesce(list_max(list_filter(range(1, j + 1), lambda k: new[k] > 0)), 1), j))), new
  FROM (
    SELECT *, list_transform(range(1, len(pred) + 1), lambda j: CASE WHEN new[j] > 0 THEN coalesce(best[j - 1], 0) + pow(new[j], {weight}) - pow(new[j] - 1, {weight}) ELSE best[j] END) AS cand
    FROM (SELECT *, list_transform(range(1, len(pred) + 1), lambda j: CASE WHEN pred[j] = ref[i + 1] THEN CASE WHEN j > 1 THEN run[j - 1] ELSE 0 END + 1 ELSE 0 END) AS new FROM lcs WHERE i < len(ref))
  )
),
score AS (
  SELECT pair_id, CASE WHEN len(pred) > 0 THEN pow(coalesce(best[-1], 0) / pow(len(pred), {weight}), 1 / {weight}) ELSE 0 END AS p,
         CASE WHEN len(ref) > 0 THEN pow(coalesce(best[-1], 0) / pow(len(ref), {weight}), 1 / {weight}) ELSE 0 END AS r
  FROM lcs WHERE i = len(ref)
)
SELECT pair_id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM score"""


@R.add("rouge_l", _lcs_sql(1.0))
def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.rouge_lcs(pairs(spark, d), "pair_id", "ref", "pred", stemmed=False), "p", "r", "f")


@R.add("rouge_w", _lcs_sql(1.2))
def rouge_w(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.rouge_lcs(pairs(spark, d), "pair_id", "ref", "pred", weight=1.2, stemmed=False), "p", "r", "f")


def _several(spark: SparkSession, d: str) -> DataFrame:
    """Each answer with two references: the user's turns before and after it."""
    talk = table(spark, d, "conversations")
    answer = talk.where("role = 'assistant'").select("conv_id", "turn", T.tokens(F.col("text")).alias("pred"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    user = talk.where("role = 'user'").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), T.tokens(F.col("text")).alias("ref"))
    joined = answer.join(user, (F.col("conv_id") == F.col("c")) & (F.col("turn") + F.col("side") == F.col("t")))
    item = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return joined.select(item.alias("item"), F.concat_ws(":", item, F.col("side").cast("string")).alias("pair_id"), "ref", "pred")


def _report(pairs: DataFrame, lcs: bool) -> DataFrame:
    pairs = materialise(pairs)
    scores = metrics.rouge_scores(pairs, "pair_id", "ref", "pred", lcs=lcs)
    of = pairs.select("item", F.col("pair_id").alias("p_id"))
    return _rounded(metrics.rouge_report(scores.join(of, F.col("pair_id") == F.col("p_id")), "item"), "p", "r", "f")


_SEVERAL = f"""several AS (
  SELECT a.conv_id || ':' || a.turn AS item, a.conv_id || ':' || a.turn || ':' || (u.turn - a.turn) AS pair_id, {sql.tokens('u.text')} AS ref, {sql.tokens('a.text')} AS pred
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND abs(u.turn - a.turn) = 1 WHERE a.role = 'assistant' AND u.role = 'user'
)"""
_OVERLAP = sql.GRAMS[sql.GRAMS.index("grams AS"):]


@R.add("rouge_n_report", f"""
WITH {_SEVERAL}, tok AS (SELECT pair_id, ref, pred FROM several), {_OVERLAP},
s AS (
  SELECT item, o.n, coalesce(CASE WHEN pred_total > 0 THEN clip / pred_total END, 0) AS p, coalesce(CASE WHEN ref_total > 0 THEN clip / ref_total END, 0) AS r
  FROM several JOIN unnest([1, 2, 3, 4]) AS o(n) ON true LEFT JOIN overlap v ON v.pair_id = several.pair_id AND v.n = o.n
),
t AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM s),
e AS (SELECT item, n, avg(p) AS ap, avg(r) AS ar, avg(f) AS af, max({{'f': f, 'r': r, 'p': p}}) AS b FROM t GROUP BY ALL)
SELECT 'rouge-' || n AS metric, 'Avg' AS aggregator, round(avg(ap), 6) AS p, round(avg(ar), 6) AS r, round(avg(af), 6) AS f FROM e GROUP BY n
UNION ALL SELECT 'rouge-' || n, 'Best', round(avg(b.p), 6), round(avg(b.r), 6), round(avg(b.f), 6) FROM e GROUP BY n""")
def rouge_n_report(spark: SparkSession, d: str) -> DataFrame:
    """Avg and Best of ROUGE-N over answers with several references, words as they are."""
    return _report(_several(spark, d), False)


@R.add("rouge_report")
def rouge_report(spark: SparkSession, d: str) -> DataFrame:
    """Avg and Best of all ROUGE kinds on stems. SQL has no stemmer; tests hold it against the same in plain Python."""
    pairs = _several(spark, d)
    return _report(pairs.select("item", "pair_id", metrics.stemmed(F.col("ref")).alias("ref"), metrics.stemmed(F.col("pred")).alias("pred")), True)


@R.add("rouge_combined", f"""
WITH {sql.GRAMS.replace("FROM pairs)", "FROM pairs UNION ALL SELECT 'b' || item_id, " + sql.tokens("text") + ", " + sql.tokens("text") + " FROM benchmark)")},
s AS (SELECT n, CASE WHEN pred_total > 0 THEN clip / pred_total ELSE 0 END AS p, CASE WHEN ref_total > 0 THEN clip / ref_total ELSE 0 END AS r FROM overlap)
SELECT n, round(sum(p) / (SELECT count(*) FROM tok), 6) AS p, round(sum(r) / (SELECT count(*) FROM tok), 6) AS r,
       round(sum(CASE WHEN p + r > 0 THEN p * r / (0.5 * p + 0.5 * r) ELSE 0 END) / (SELECT count(*) FROM tok), 6) AS f FROM s GROUP BY n""")
def rouge_combined(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-N over the pairs of several sets together."""
    return _rounded(metrics.rouge_n(_combined(spark, d), "pair_id", "ref", "pred"), "p", "r", "f")


@R.add("novelty", """
SELECT count(*) AS n, count(*) FILTER (NOT hit) AS n_new, round(avg((NOT hit)::INT), 6) AS novelty
FROM (SELECT text IN (SELECT text FROM benchmark UNION SELECT text FROM documents WHERE lang = 'en') AS hit FROM documents)""")
def novelty(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    known = table(spark, d, "benchmark").select("text").unionByName(docs.where("lang = 'en'").select("text"))
    return _rounded(metrics.novelty(docs.select("text"), known), "novelty")


@R.add("distinctness", """
WITH cells AS (SELECT source, md5(text) AS c, count(*) AS k FROM documents GROUP BY ALL),
w AS (SELECT c, count(*) AS items, sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS w, sum(k) AS r FROM cells GROUP BY c),
t AS (SELECT count(*) FILTER (items = 1) AS nr_distinct, coalesce(sum(items) FILTER (items > 1), 0)::BIGINT AS nr_duplicate_total, sum(w)::BIGINT AS within_item_duplicates, sum(r) AS n FROM w)
SELECT nr_distinct, nr_duplicate_total, within_item_duplicates, round(nr_distinct / (nr_distinct + nr_duplicate_total), 6) AS fraction_distinct,
       round(within_item_duplicates / n, 6) AS fraction_within_duplicates FROM t""")
def distinctness(spark: SparkSession, d: str) -> DataFrame:
    """Texts as captions, sources as items."""
    rows = table(spark, d, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("c"))
    return _rounded(metrics.distinctness(rows, "source", "c"), "fraction_distinct", "fraction_within_duplicates")


def _diversity_sql(more: str = "") -> str:
    return f"""
WITH {sql.PAIRS.strip()},
both_sets AS (SELECT ref_text, pred_text FROM pairs {more}),
nov AS (SELECT avg((pred_text NOT IN (SELECT text FROM benchmark))::INT) AS novelty FROM both_sets),
cells AS (SELECT ref_text, pred_text AS c, count(*) AS k FROM both_sets GROUP BY ALL),
w AS (SELECT c, count(*) AS items, sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS w, sum(k) AS r FROM cells GROUP BY c),
t AS (SELECT count(*) FILTER (items = 1) AS nr_distinct, coalesce(sum(items) FILTER (items > 1), 0)::BIGINT AS nr_duplicate_total, sum(w)::BIGINT AS within_item_duplicates, sum(r) AS n FROM w),
a AS (SELECT count(DISTINCT w) AS n FROM (SELECT unnest({sql.tokens('text')}) AS w FROM benchmark)),
b AS (SELECT count(DISTINCT w) AS n FROM (SELECT unnest({sql.tokens('pred_text')}) AS w FROM both_sets)),
c AS (SELECT count(DISTINCT w) AS n FROM (SELECT unnest({sql.tokens('ref_text')}) AS w FROM both_sets))
SELECT round(novelty, 6) AS novelty_score, round(nr_distinct / (nr_distinct + nr_duplicate_total), 6) AS fraction_distinct, nr_distinct, nr_duplicate_total, within_item_duplicates,
       round(within_item_duplicates / t.n, 6) AS fraction_within_duplicates, a.n AS vocab_size_ref, b.n AS vocab_size_predictions,
       round(b.n / a.n, 6) AS vocab_perc_intrain, round(b.n / c.n, 6) AS vocab_perc_inref, round(a.n / c.n, 6) AS vocab_per_test_train
FROM nov, t, a, b, c"""


def _diversity(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    train = table(spark, d, "benchmark").select("text", T.tokens(F.col("text")).alias("words"))
    out = metrics.diversity(pairs, train, "ref", "pred")
    return _rounded(out, *[c for c, kind in out.dtypes if kind == "double"])


@R.add("diversity_summary", _diversity_sql())
def diversity_summary(spark: SparkSession, d: str) -> DataFrame:
    return _diversity(spark, d, pairs(spark, d))


@R.add("diversity_combined", _diversity_sql("UNION ALL SELECT text, text FROM benchmark"))
def diversity_combined(spark: SparkSession, d: str) -> DataFrame:
    """The measures over the pairs of several sets together."""
    return _diversity(spark, d, _combined(spark, d))


_GUESS = "CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END"


@R.add("accuracy", f"SELECT count(*) AS n, round(avg((quality = {_GUESS})::INT), 6) AS accuracy FROM labels JOIN documents USING (doc_id)")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", F.expr(_GUESS).alias("guess"))
    return _rounded(metrics.accuracy(rows, "quality", "guess"), "accuracy")


@R.add("confusion_matrix", f"SELECT quality AS true_label, {_GUESS} AS predicted_label, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", F.expr(_GUESS).alias("guess"))
    return metrics.confusion(rows, "quality", "guess")


@R.add("style_error", f"""
SELECT round(avg((quality = {_GUESS})::INT), 6) AS accuracy_reference, round(avg((quality = toxic)::INT), 6) AS accuracy_prediction,
       round(avg((quality = {_GUESS} AND quality <> toxic)::INT), 6) AS style_error FROM labels JOIN documents USING (doc_id)""")
def style_error(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("quality", "toxic", F.expr(_GUESS).alias("guess"))
    out = metrics.style_error(rows, "quality", "guess", "toxic")
    return _rounded(out, *out.columns)


@R.add("masked_xent", "SELECT round(sum(-ln(p)) FILTER (user_id <> 0) / count(*) FILTER (user_id <> 0), 6) AS loss FROM (SELECT user_id, 1 / (1 + abs(value)) AS p FROM events)")
def masked_xent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (1 / (1 + F.abs("value"))).alias("p"))
    return _rounded(metrics.masked_cross_entropy(rows, "user_id", "p"), "loss")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'assistant'").select(T.tokens(F.col("text")).alias("w"))


@R.add("greedy_decode", f"""
WITH RECURSIVE texts AS (SELECT list_concat(list_concat(['startseq'], {sql.tokens('text')}), ['endseq']) AS w FROM conversations WHERE role = 'assistant'),
bi AS (SELECT w[i] AS prev, w[i + 1] AS nxt, count(*) AS n FROM texts, unnest(range(1, len(w))) g(i) GROUP BY ALL),
best AS (SELECT prev, nxt FROM bi QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, nxt) = 1),
{sql.PAIR_TOKENS.strip()},
run AS (
  SELECT pair_id, coalesce(ref[1], 'startseq') AS last, []::VARCHAR[] AS words, 0 AS step FROM tok
  UNION ALL
  SELECT pair_id, coalesce(nxt, 'endseq'), CASE WHEN coalesce(nxt, 'endseq') = 'endseq' THEN words ELSE list_append(words, nxt) END, step + 1
  FROM run LEFT JOIN best ON last = prev WHERE last <> 'endseq' AND step < 20
)
SELECT pair_id, array_to_string(words, ' ') AS words, len(words)::INT AS n FROM run WHERE last = 'endseq' OR step = 20""")
def greedy_decode(spark: SparkSession, d: str) -> DataFrame:
    """A continuation of each reference's first word, by the bigrams of the answers."""
    inputs = pairs(spark, d).select("pair_id", F.get("ref", F.lit(0)).alias("first"))
    return decode.greedy(inputs, "pair_id", decode.bigram_scorer(_words(spark, d), "w"), 20, "first")


@R.add("greedy_by_language", f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(lang, '') AS lang, {sql.tokens('text')} AS t FROM documents),
texts AS (SELECT lang, list_concat(list_concat(['startseq'], t), ['endseq']) AS w FROM docs),
bi AS (SELECT lang, w[i] AS prev, w[i + 1] AS nxt, count(*) AS n FROM texts, unnest(range(1, len(w))) g(i) GROUP BY ALL),
best AS (SELECT lang, prev, nxt FROM bi QUALIFY row_number() OVER (PARTITION BY lang, prev ORDER BY n DESC, nxt) = 1),
run AS (
  SELECT doc_id, lang, coalesce(t[1], 'startseq') AS last, []::VARCHAR[] AS words, 0 AS step FROM docs
  UNION ALL
  SELECT doc_id, run.lang, coalesce(nxt, 'endseq'), CASE WHEN coalesce(nxt, 'endseq') = 'endseq' THEN words ELSE list_append(words, nxt) END, step + 1
  FROM run LEFT JOIN best ON last = prev AND run.lang = best.lang WHERE last <> 'endseq' AND step < 10
)
SELECT doc_id, array_to_string(words, ' ') AS words, len(words)::INT AS n FROM run WHERE last = 'endseq' OR step = 10""")
def greedy_by_language(spark: SparkSession, d: str) -> DataFrame:
    """A continuation of each document's first word, by the bigrams of its own language's documents."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), T.tokens(F.col("text")).alias("t"))
    inputs = docs.select("doc_id", "lang", F.get("t", F.lit(0)).alias("first"))
    return decode.greedy(inputs, "doc_id", decode.bigram_scorer(docs, "t", "lang"), 10, "first", "lang")


@R.add("beam_search", f"""
WITH RECURSIVE texts AS (SELECT list_concat(list_concat(['startseq'], {sql.tokens('text')}), ['endseq']) AS w FROM conversations WHERE role = 'assistant'),
bi AS (SELECT w[i] AS prev, w[i + 1] AS nxt, count(*) AS n FROM texts, unnest(range(1, len(w))) g(i) GROUP BY ALL),
prob AS (SELECT prev, nxt, n / sum(n) OVER (PARTITION BY prev) AS p FROM bi),
top AS (SELECT prev, nxt, round(ln(p), 9) AS lp, row_number() OVER (PARTITION BY prev ORDER BY p DESC, nxt) AS r FROM prob QUALIFY r <= 3),
{sql.PAIR_TOKENS.strip()},
run AS (
  SELECT pair_id, coalesce(ref[1], 'startseq') AS last, []::VARCHAR[] AS words, 0.0::DOUBLE AS score, 3 AS k, false AS shrinks, 0 AS step FROM tok
  UNION ALL
  SELECT pair_id, nxt, CASE WHEN nxt = 'endseq' THEN words ELSE list_append(words, nxt) END, sc, k - shrinks_now::INT, shrinks_now, step + 1
  FROM (
    SELECT *, shrinks OR max((r = 1 AND nxt = 'endseq')::INT) OVER (PARTITION BY pair_id) = 1 AS shrinks_now,
           row_number() OVER (PARTITION BY pair_id ORDER BY sc DESC, array_to_string(list_append(words, nxt), ' ')) AS place
    FROM (
      SELECT pair_id, words, k, shrinks, step, coalesce(nxt, 'endseq') AS nxt, coalesce(r, 1) AS r, round(score + coalesce(lp, 0.0), 9) AS sc
      FROM run LEFT JOIN top ON last = prev WHERE last <> 'endseq' AND k > 0 AND step < 12
    )
  ) WHERE place <= k
),
ended AS (
  SELECT pair_id, array_to_string(words, ' ') AS words, CASE WHEN last = 'endseq' THEN score / (len(words) + 1) ELSE score / len(words) END AS s
  FROM run WHERE step > 0 AND (last = 'endseq' OR step = 12 AND k > 0)
)
SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY s DESC, words)::INT AS place, words, round(s, 6) AS score FROM ended""")
def beam_search(spark: SparkSession, d: str) -> DataFrame:
    """The best continuations of each reference's first word, by the bigrams of the answers."""
    inputs = pairs(spark, d).select("pair_id", F.get("ref", F.lit(0)).alias("first"))
    return _rounded(decode.beam(inputs, "pair_id", decode.bigram_scorer(_words(spark, d), "w"), start="first"), "score")


@R.add("stream_dedupe", "SELECT split_part(url, '?', 1) AS url, count(DISTINCT split_part(url, '?', 1)) AS n FROM pages GROUP BY 1")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Links that the stream let through, with how often."""
    root = materialise(spark.range(1)).inputFiles()[0].rpartition("/")[0].rpartition("/")[0]
    return seen.run_available(spark, f"{d}/pages.parquet", root).groupBy(F.col("seen_key").alias("url")).agg(F.count("*").alias("n"))


@R.add("seen_sections", """
SELECT section, n, ceil(n / 10)::BIGINT AS flushes FROM (
  SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS section, count(DISTINCT split_part(url, '?', 1)) AS n FROM pages GROUP BY 1
)""")
def seen_sections(spark: SparkSession, d: str) -> DataFrame:
    """Links that the stream saw for the first time in each host's section, and the flushes of ten that they came in.
    The pages come first, the ends of the sections after a restart."""
    root = working_folder(spark)
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    rows = table(spark, d, "pages").select(host.alias("section"), T.canonical_url(F.col("url")).alias("item"), F.lit("first").alias("run"))
    rows.write.parquet(f"{root}/landing")
    sections.run_available(spark, f"{root}/landing", root)
    rows.select("section").distinct().select("section", F.lit(None).cast("string").alias("item"), F.lit("first").alias("run")).write.mode("append").parquet(f"{root}/landing")
    found = sections.run_available(spark, f"{root}/landing", root)
    return found.groupBy("section").agg(F.sum(F.size("items")).alias("n"), F.count("*").alias("flushes"))


@R.add("source_classify")
def source_classify(spark: SparkSession, d: str) -> DataFrame:
    """Predicted language of every document, learned from the training part."""
    return classify.classify_texts(table(spark, d, "documents"), "doc_id", "text", "lang")
