"""The stages of the pipeline on a fixture, against what brute force says of each."""

import sentencepiece

import corpus_pipeline
from weftline.llm import pieces, toxicity
from .conftest import DOCS, TEXTS
from .test_queries import near_brute


def test_stages(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, edge).cache()
        if stage is not corpus_pipeline.encode:
            assert out.columns == [f.name for f in DOCS] and out.schema.simpleString() == docs.schema.simpleString()
        kept.append(out.collect())
        before, docs = docs, out
    toxic, exact, near, mixed, encoded = kept
    scores = toxicity.score_documents(spark.read.parquet(f"{edge}/documents.parquet"), toxicity.train(spark.read.parquet(f"{edge}/documents.parquet"), spark.read.parquet(f"{edge}/labels.parquet")))
    assert len(toxic) == scores.where("score < 0.5").count()
    texts = {"".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r") for r in toxic}
    assert len(exact) == len(texts) == len({"".join(c for c in r["text"] or "" if c not in " \t\n\x0b\x0c\r") for r in exact})
    stay = [r for r in near_brute([(r["doc_id"], r["text"]) for r in exact]) if r[3]]
    assert sorted(map(repr, (r["doc_id"] for r in near))) == sorted(repr(r[0]) for r in stay)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = [(r["doc_id"], model.encode(r["text"] or "") + [2]) for r in mixed]
    assert sorted(((r["doc_id"], r["ids"]) for r in encoded), key=repr) == sorted(want, key=repr)


def test_whole(spark, edge):
    out = corpus_pipeline.run(spark, edge)
    assert {r[0] for r in out.select("doc_id").collect()} <= {i for i, _ in TEXTS} and out.where("n_tokens <> size(ids)").count() == 0


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
