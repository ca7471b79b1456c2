"""The library's queries against DuckDB, and hand-made cases for each rule that real rows do not show."""

import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftline.functions import stem, text as T, vectors as V
from weftline.operators import corpus, decode, metrics, sequence, vocab
from weftline.plans import queries
from weftline.plans.lineage import materialise, number_rows, rank_within
from weftline.sources import tables
from weftline.streaming import seen

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "none" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    rows = got.collect()
    if name not in queries.SQL:
        assert rows
        return
    want = duck.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    found = sorted("|".join(plain(r[c]) for c in columns) for r in rows)
    expected = sorted("|".join(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert found == expected


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def words(spark, text):
    return spark.range(1).select(T.tokens(F.lit(text)).alias("w")).first()[0]


@pytest.mark.parametrize("text,want", [
    ("", []), (None, []), ("!!! ...", []), ("a b cd", ["cd"]), ("Room 12 b2b", ["room"]), ("<p>Hi</p>", ["phip"]), ('<a href="https://x.com">', []),
    ("Élan  vital ok", ["élan", "vital", "ok"]), ("don't", ["dont"]),
])
def test_tokens(spark, text, want):
    assert words(spark, text) == want


def test_clean(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.clean(F.lit("<p>Hi, There</p>"))) == "hi there"
    assert one(T.clean(F.lit("<p>Hi</p>"), legacy=True)) == "phip"
    assert one(T.url_parameter(F.lit("http://a/b?x=1&color=abcd"), "color", 3, "NF__")) == "abc"
    assert one(T.url_parameter(F.lit("http://a/b"), "color", 3, "NF__")) == "NF__"
    assert one(T.joined_key(F.lit("A"), F.lit(None), F.lit("x?/y"))) == "A_None_xy"
    assert one(T.listed(F.lit('<b>Wash, cold</b><br>"<br>dry\n'))) == ["Wash cold", "dry"]
    key, number = T.file_key(F.lit("AB__12_c_13.jpg"))
    assert (one(key), one(number)) == ("AB_12_c", 13)


def test_pad(spark):
    seq = F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.pad(seq, 5, True)) == [0, 0, 1, 2, 3] and one(T.pad(seq, 2, True)) == [2, 3]
    assert one(T.pad(seq, 5, False)) == [1, 2, 3, 0, 0] and one(T.pad(seq, 2, False)) == [1, 2]


def test_vocabulary(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", "a", "d"]), (3, [])], "id long, w array<string>")
    index = {r["word"]: r["ix"] for r in vocab.index(rows, "id", "w", 2).collect()}
    assert index == {"b": 1, "a": 2}
    known = vocab.index(rows, "id", "w", 2)
    encoded = vocab.encode(rows, "id", "w", known)
    assert dict(encoded.collect()) == {1: [1, 2, 1], 2: [2], 3: []}
    assert dict(vocab.decode(encoded, "id", "seq", known).collect()) == {1: "b a b", 2: "a", 3: ""}
    assert {r["word"]: r["ix"] for r in vocab.index_by_frequency(rows, "id", "w").collect()} == {"b": 1, "a": 2, "c": 3, "d": 4}


def test_sequences(spark):
    rows = spark.createDataFrame([(1, [5, 6, 7]), (2, [9]), (3, [])], "id long, seq array<bigint>")
    assert sorted(map(tuple, sequence.next_words(rows, "id", "seq", 2).collect())) == [(1, 1, [0, 5], 6), (1, 2, [5, 6], 7)]
    assert [tuple(r) for r in sequence.shifted(rows, "id", "seq", 3).collect()] == [(1, [5, 6, 0], [6, 7, 0])]


def pairs(spark, rows):
    return spark.createDataFrame([(i, a.split(), b.split()) for i, (a, b) in enumerate(rows)], "id long, ref array<string>, pred array<string>")


PAIRS = [("a b c d e", "a b c d e"), ("a b c", "x y z"), ("the cat sat", "the the the the"), ("a b c d e f", "a b"), ("p q", "")]


def test_bleu(spark):
    same = metrics.bleu(pairs(spark, [PAIRS[0]]), "id", "ref", "pred").first()
    assert list(same) == [1.0] * 4
    none = metrics.bleu(pairs(spark, [PAIRS[1], PAIRS[4]]), "id", "ref", "pred").first()
    assert list(none) == [0.0] * 4
    clip, total, c, r = [0] * 5, [0] * 5, 0, 0
    for ref, pred in PAIRS:
        ref, pred = ref.split(), pred.split()
        c, r = c + len(pred), r + len(ref)
        for n in range(1, 5):
            a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (ref, pred))
            clip[n] += sum((a & b).values())
            total[n] += sum(b.values())
    got = metrics.bleu(pairs(spark, PAIRS), "id", "ref", "pred").first()
    for n in range(1, 5):
        want = (1 if c > r else math.exp(1 - r / c)) * math.exp(sum(math.log(clip[k] / total[k]) for k in range(1, n + 1)) / n)
        assert abs(got[n - 1] - want) < 1e-9


def test_rouge(spark):
    got = {r["id"]: r for r in metrics.rouge_lcs(pairs(spark, PAIRS), "id", "ref", "pred").collect()}
    assert got[0]["f"] == 1 and got[1]["f"] == 0 and got[4]["f"] == 0
    assert abs(got[2]["p"] - 1 / 4) < 1e-9 and abs(got[2]["r"] - 1 / 3) < 1e-9
    weighted = {r["id"]: r["f"] for r in metrics.rouge_lcs(pairs(spark, [("a b c d", "a b c d"), ("a b c d", "a x b y c d")]), "id", "ref", "pred", 1.2).collect()}
    assert abs(weighted[0] - 1) < 1e-9 and weighted[1] < 0.8
    plural = metrics.rouge_lcs(pairs(spark, [("running dogs", "run dog")]), "id", "ref", "pred").first()
    assert plural["f"] == 1


def rouge_brute(ref, pred):
    """(p, r, f) by kind for two lists of stems."""
    out = {}

    def put(kind, p, r):
        out[kind] = (p, r, 2 * p * r / (p + r) if p + r else 0.0)

    for n in (1, 2, 3, 4):
        a, b = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (ref, pred))
        both = (a & b).total()
        put(f"rouge-{n}", both / b.total() if b else 0.0, both / a.total() if a else 0.0)
    for kind, w in (("rouge-l", 1.0), ("rouge-w", 1.2)):
        best, run = Counter(), Counter()
        for i in range(1, len(ref) + 1):
            for j in range(1, len(pred) + 1):
                if ref[i - 1] == pred[j - 1]:
                    k = run[i - 1, j - 1]
                    best[i, j], run[i, j] = best[i - 1, j - 1] + (k + 1) ** w - k**w, k + 1
                else:
                    best[i, j] = max(best[i - 1, j], best[i, j - 1])
        both = best[len(ref), len(pred)]
        put(kind, *((both / len(x) ** w) ** (1 / w) if x else 0.0 for x in (pred, ref)))
    return out


def test_rouge_report(spark):
    """Averages and bests of all kinds on stems, each answer with the user's turns around it."""
    talk = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = talk.select("conv_id", "turn", "role", T.tokens(F.col("text")).alias("w")).collect()
    users = {(r["conv_id"], r["turn"]): [stem.stem(x) for x in r["w"]] for r in rows if r["role"] == "user"}
    items = []
    for r in rows:
        near = [users[k] for k in ((r["conv_id"], r["turn"] - 1), (r["conv_id"], r["turn"] + 1)) if k in users]
        if r["role"] == "assistant" and near:
            items.append([rouge_brute(ref, [stem.stem(x) for x in r["w"]]) for ref in near])
    got = {(r["metric"], r["aggregator"]): (r["p"], r["r"], r["f"]) for r in queries.QUERIES["rouge_report"](spark, SMALL).collect()}
    assert len(got) == 12 and any(len(i) > 1 for i in items)
    for kind in items[0][0]:
        avg = [sum(sum(s[kind][k] for s in i) / len(i) for i in items) / len(items) for k in range(3)]
        tops = [max((s[kind] for s in i), key=lambda s: (s[2], s[1], s[0])) for i in items]
        best = [sum(t[k] for t in tops) / len(items) for k in range(3)]
        assert got[kind, "Avg"] == pytest.approx(avg, abs=2e-6) and got[kind, "Best"] == pytest.approx(best, abs=2e-6)


def test_stemmed_lists(spark):
    rows = spark.createDataFrame([(1, ["running", "dogs"]), (2, []), (3, None), (4, ["flies"])], "id long, w array<string>")
    got = dict(rows.select("id", metrics.stemmed(F.col("w"))).collect())
    assert got[1] == [stem.stem("running"), "dog"] and got[2] == [] and not got[3] and got[4] == ["fli"]


def test_classifier_quality(spark):
    """Texts of languages are told apart on rows that were not learned from."""
    rows = [r for r in queries.QUERIES["source_classify"](spark, "/root/testdata/sf0.01").collect() if r["part"] == "TEST" and r["label"]]
    assert len(rows) > 150 and sum(r["label"] == r["predicted"] for r in rows) / len(rows) > 0.95


def test_classifier_labels(spark):
    from weftline.operators import classify

    with pytest.raises(ValueError):
        classify.classify_texts(spark.createDataFrame([(1, "a b", None)], "id long, text string, y string"), "id", "text", "y")


@pytest.mark.parametrize("word,want", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
    ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("operator", "oper"), ("hopefulness", "hope"), ("triplicate", "triplic"),
    ("formalize", "formal"), ("electrical", "electr"), ("goodness", "good"), ("allowance", "allow"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"),
])
def test_stem(word, want):
    assert stem.stem(word) == want


def test_distinctness(spark):
    rows = spark.createDataFrame([("i", "a"), ("i", "a"), ("i", "b"), ("j", "b"), ("j", "c")], "item string, cap string")
    got = metrics.distinctness(rows, "item", "cap").first()
    assert list(got)[:3] == [2, 2, 2] and got["fraction_distinct"] == 0.5 and got["fraction_within_duplicates"] == 0.4
    assert metrics.novelty(spark.createDataFrame([("a",), ("b",), ("b",)], "text string"), spark.createDataFrame([("a",)], "text string")).first()["novelty"] == 2 / 3


def test_numbers_and_splits(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i % 10 else None) for i in range(500)], "id long, g string").repartition(7)
    assert sorted(r["n"] for r in number_rows(rows, "id").collect()) == list(range(1, 501))
    ranks = rank_within(rows, "g", "id").collect()
    assert all(sorted(r["rank"] for r in ranks if r["g"] == g) == list(range(1, 1 + sum(r["g"] == g for r in ranks))) for g in ("a", "b", None))
    parts = Counter(r["part"] for r in corpus.split_parts(rows, "id").collect())
    assert parts == {"TRAIN": 375, "VAL": 25, "TEST": 100}
    assert corpus.batches_of(rows, 32, "id", whole=True).count() == 480
    assert {r["part"] for r in corpus.stratified_sample(rows.limit(20), "g", "id", 100, 25).collect()} <= {"TRAIN", "TEST"}


def test_best_and_fallback(spark):
    found = spark.createDataFrame([("x", 0.5, 1, "a"), ("x", 0.9, 2, "b"), ("x", 0.9, 3, "c"), ("y", 0.1, 4, "d")], "img string, score double, pos int, cat string")
    assert {r["img"]: r["cat"] for r in corpus.best_of(found, "img", "score", "pos").collect()} == {"x": "c", "y": "d"}
    left = spark.createDataFrame([("k1",), ("k22",), ("zz",)], "k string")
    right = spark.createDataFrame([("k1", 1), ("k2", 2)], "c string, v int")
    assert {r["k"]: r["v"] for r in corpus.with_fallback(left, right, "k", "c", F.expr("substring(k, 1, length(k) - 1)")).collect()} == {"k1": 1, "k22": 2}


def scorer(spark):
    rows = [("startseq", "a", 0.6), ("startseq", "b", 0.4), ("a", "c", 0.55), ("a", "endseq", 0.45), ("b", "endseq", 1.0), ("c", "c", 1.0)]
    return spark.createDataFrame(rows, "prev string, next string, prob double")


def test_decoders(spark):
    inputs = spark.createDataFrame([(1, None), (2, "b")], "id long, first string")
    got = {r["id"]: (r["words"], r["n"]) for r in decode.greedy(inputs, "id", scorer(spark), 7, "first").collect()}
    assert got == {1: ("a c c c c c c", 7), 2: ("", 0)}  # one branch never ends
    best = {r["place"]: r["words"] for r in decode.beam(inputs.select("id").where("id = 1"), "id", scorer(spark), 2, 6).collect()}
    assert best[1] in ("b", "a", "a c c c c c") and {"b"} <= set(best.values())


def test_decoders_by_context(spark):
    """Each input meets the distributions of its own context; a null context is one of its own."""
    texts = spark.createDataFrame([("x", ["a", "b"]), ("x", ["a", "b"]), ("y", ["a", "c"]), (None, ["a", "d"]), ("y", [])], "ctx string, w array<string>")
    inputs = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "id long, ctx string").withColumn("first", F.lit("a"))
    by = decode.bigram_scorer(texts, "w", "ctx").unionByName(spark.createDataFrame([(None, "a", "d", 1.0)], "ctx string, prev string, next string, prob double"))
    assert dict(decode.greedy(inputs, "id", by, 5, "first", "ctx").select("id", "words").collect()) == {1: "b", 2: "c", 3: "d", 4: ""}
    best = decode.beam(inputs, "id", by, 2, 5, "first", "ctx").where("place = 1").select("id", "words")
    assert dict(best.collect()) == {1: "b", 2: "c", 3: "d", 4: ""}
    assert dict(decode.greedy(inputs, "id", decode.bigram_scorer(texts, "w"), 5, "first").select("id", "words").collect()) == {i: "b" for i in (1, 2, 3, 4)}


def beam_brute(first, probs, width=3, most=12):
    live, done, k, shrinks = [(first, [], 0.0)], [], width, False
    for _ in range(most):
        grown = []
        for last, words, score in live:
            best = sorted(probs.get(last, {"endseq": 1.0}).items(), key=lambda x: (-x[1], x[0]))[:width]
            grown += [(score + math.log(p), words, w) for w, p in best]
            shrinks |= best[0][0] == "endseq"
        grown = sorted(grown, key=lambda g: (-g[0], " ".join([*g[1], g[2]])))[:k]
        k -= shrinks
        done += [(words, score / (len(words) + 1)) for score, words, w in grown if w == "endseq"]
        live = [(w, [*words, w], score) for score, words, w in grown if w != "endseq" and k > 0]
        if not live:
            break
    done += [(words, score / len(words)) for _, words, score in live]
    done = sorted(((" ".join(w), s) for w, s in done), key=lambda x: (-x[1], x[0]))
    return [(place, w, round(s, 6)) for place, (w, s) in enumerate(done, 1)]


def test_beam_of_every_pair(spark, tmp_path):
    """Each pair's beam begins after the first word of its reference, known to the scorer or not, or after the start token."""
    talk = [("red shoes", "red shoes fit well"), ("blue hat", "the blue hat is warm"), ("the coat", "the coat is red"), ("zebra", "red hat"), ("", "the red coat is red and warm"), ("blue", "blue shoes and the blue hat")]
    rows = [(c, t, r, x) for c, pair in enumerate(talk) for t, (r, x) in enumerate(zip(("user", "assistant"), pair))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    counts = {}
    for _, answer in talk:
        w = ["startseq", *answer.split(), "endseq"]
        for a, b in zip(w, w[1:]):
            counts.setdefault(a, Counter())[b] += 1
    probs = {a: {b: n / c.total() for b, n in c.items()} for a, c in counts.items()}
    got = sorted(tuple(r) for r in queries.QUERIES["beam_search"](spark, str(tmp_path)).select("pair_id", "place", "words", "score").collect())
    firsts = {f"{c}:0": (ref.split() or ["startseq"])[0] for c, (ref, _) in enumerate(talk)}
    assert got == sorted((p, *h) for p, first in firsts.items() for h in beam_brute(first, probs))
    assert {r[0] for r in got} == set(firsts) and len({r[2] for r in got if r[1] == 1}) > 2


def test_vectors_file(spark, tmp_path):
    path = tmp_path / "vec.50d.txt"
    path.write_text("2 3\nw 1 2 3\nbad 1 x 3\nv 4 5 6\nw 7 8 9\n")
    assert dict(tables.vectors(spark, str(path), 3).collect()) == {"w": [7.0, 8.0, 9.0], "v": [4.0, 5.0, 6.0]}
    assert tables.vector_dim(path.name) == 50
    with pytest.raises(ValueError):
        tables.vector_dim("glove.txt")


def test_items(spark, tmp_path):
    for at, body in (("shop/ANNOS/women/dresses/a.txt", '{"url": "u", "description": "Nice"}'), ("shop/ANNOS/tops/b.txt", '{"url": "v"}'), ("shop/ANNOS/tops/c.txt", "{broken"), ("shop/ANNOS/tops/d.ini", "{}")):
        os.makedirs((tmp_path / at).parent, exist_ok=True)
        (tmp_path / at).write_text(body)
    read = tables.items(spark, str(tmp_path))
    good, bad = tables.good_and_bad(read)
    assert [(r["shop"], r["gender"], r["category"], r["url"]) for r in good.collect()] == [("shop", "women", "dresses", "u")]
    assert bad.count() == 1 and read.count() == 3


def test_configs_and_writers(spark, tmp_path):
    (tmp_path / "UO_1.json").write_text('{"nr_epochs": 3}')
    (tmp_path / "MA_2.json").write_text('{"nr_epochs": 5, "extra": "x"}')
    got = tables.configs(spark, "UO_1.json-MA_2.json", {"UO": str(tmp_path), "MA": str(tmp_path)})
    assert {r["config"]: r["nr_epochs"] for r in got.collect()} == {"UO_1.json": 3, "MA_2.json": 5}
    for kind in ("parquet", "json", "csv"):
        tables.write(spark.range(3), f"{tmp_path}/{kind}", kind)
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == spark.read.json(f"{tmp_path}/json").count() == 3
    (tmp_path / "img").mkdir()
    png = bytes.fromhex("89504E470D0A1A0A") + b"data" + bytes.fromhex("0000000049454E44AE426082")
    files = {"a.jpg": b"\xff\xd8\xff\xe0data\xff\xd9", "b.png": png, "c.gif": b"GIF89adata;", "empty.jpg": b"", "text.jpg": b"no image", "cut.jpg": b"\xff\xd8\xff\xe0da", "cut.png": png[:-4]}
    for name, data in files.items():
        (tmp_path / "img" / name).write_bytes(data)
    assert sorted(r["path"][-5:] for r in tables.images(spark, f"{tmp_path}/img").collect()) == ["a.jpg", "b.png", "c.gif"]


def test_stream_keeps_its_state(spark, tmp_path):
    spark.createDataFrame([(1, "a?x=1"), (2, "a?x=2"), (3, "b")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    out = seen.run_available(spark, f"{tmp_path}/pages.parquet", f"{tmp_path}/state")
    batch = spark.read.parquet(f"{tmp_path}/pages.parquet").select(T.canonical_url(F.col("url")).alias("u")).distinct()
    assert sorted(r["seen_key"] for r in out.collect()) == sorted(r["u"] for r in batch.collect()) == ["a", "b"]


def test_rounded_keeps_the_sign_of_zero(spark):
    """As SQL's round() of a double (F6 and F7 of round 3): -1e-9 becomes -0.0, which compares as another value bit by bit."""
    values = [-1e-9, 1e-9, 0.0, -0.0, -4.9e-7, -5e-7, 0.1234565, -0.1234565, 1e300, float("inf"), float("-inf"), None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r["r"] for r in rows.select("k", V.rounded(F.col("v"), 6).alias("r")).orderBy("k").collect()]
    want = [r[0] for r in duckdb.sql("SELECT round(unnest(?::DOUBLE[]), 6)", params=[values]).fetchall()]
    assert list(map(repr, got)) == list(map(repr, want))
    assert repr(spark.createDataFrame([(float("nan"),)], "v double").select(V.rounded(F.col("v"), 6)).first()[0]) == "nan"
    tiny = spark.createDataFrame([([-1e-8] * 16,)], "v array<float>").select(V.position_mean(F.col("v"), 8, 6).alias("m")).first()["m"]
    assert list(map(repr, tiny)) == ["-0.0"] * 8


def test_part_of_is_split_parts(spark):
    """Without a join or a shuffle of the rows (F8 of round 3)."""
    rows = spark.range(0, 101, 1, 3).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.lit("wide").alias("x"))
    got = rows.withColumn("part", corpus.part_of(rows, "k"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["part"] for r in got.collect()} == {r["k"]: r["part"] for r in corpus.split_parts(rows, "k").collect()}
    few = spark.range(1).select(F.col("id").alias("k"))
    assert few.select(corpus.part_of(few, "k").alias("p")).first()["p"] == "TEST" and few.limit(0).select(corpus.part_of(few.limit(0), "k").alias("p")).count() == 0


def test_ngrams_of_pairs_stay_in_place(spark):
    """Only keys that stand more than once have their n-grams shuffled (F11 to F13 of round 3); both ways agree."""
    rows = [("a", ["x", "y", "x", "y"], ["x", "y", "z"]), ("b", [], ["x"]), ("c", None, None), ("d", ["x"], ["x", "x"]), ("d", ["x", "y"], ["y"]), (None, ["x"], ["x"]), (None, ["x"], []), ("e", ["x", None, "y"], ["x", "y"])]
    pairs = spark.createDataFrame(rows, "k string, ref array<string>, pred array<string>")
    want = {tuple(r) for r in metrics._shuffled_counts(pairs, "k", "ref", "pred", metrics.ORDERS).collect()}
    got = [tuple(r) for r in metrics.ngram_counts(pairs, "k", "ref", "pred").collect()]
    assert set(got) == want and len(got) == len(want)
    assert ("d", 1, "x", 2, 2) in want and (None, 1, "x", 1, 2) in want
    over = {(r["k"], r["n"]): tuple(r)[2:] for r in metrics.ngram_overlap(pairs, "k", "ref", "pred").collect()}
    assert over["a", 1] == (2, 3, 4) and over["d", 1] == (3, 3, 3) and ("c", 1) not in over and over["b", 1] == (0, 1, 0)
    once, twice = metrics._by_repetition(pairs, "k")
    assert sorted(map(str, (r["k"] for r in once.collect()))) == ["a", "b", "c", "e"] and twice.count() == 4
    plan = metrics.ngram_overlap(materialise(pairs), "k", "ref", "pred")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # both of the repeated keys' n-grams
