"""Runs of periodic words against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import periodic
from .conftest import documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=periodic.LEAST, times=periodic.TIMES):
    """Every stretch of equal distances, by increasing period; what is found first has the least period."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(kept))


def repetitive(r):
    d = []
    while r.random() < 0.85:
        kind = r.random()
        if kind < 0.5:
            d += [r.randrange(3) for _ in range(r.randint(1, 6))] * r.randint(1, 12)
        elif kind < 0.7:
            d += [r.randrange(2)] * r.randint(1, 40)
        elif kind < 0.85 and d:
            a = r.randrange(len(d))
            d += d[a : a + r.randint(1, 30)]
        else:
            d += [r.randrange(50) for _ in range(r.randint(1, 20))]
    return d


@pytest.mark.parametrize("least,times", [(24, 3), (4, 2), (6, 3), (2, 2)])
def test_runs_of_many_documents(least, times):
    r = random.Random(least)
    for _ in range(80):
        docs = [repetitive(r) for _ in range(r.randint(1, 5))]
        first = np.r_[0, np.cumsum([len(d) for d in docs])]
        words = np.array([x * 10 + k for k, d in enumerate(docs) for x in d], np.uint64)
        want = [(s + int(first[k]), s + n + int(first[k]), q) for k, d in enumerate(docs) for s, n, q in brute_runs(d, least, times)]
        assert periodic.runs_of(words, first, least, times) == want


def test_suffixes_and_nodes():
    words = np.array([1, 2, 1, 2, 1, 3, 1, 2], np.uint64)
    s = periodic.sort_suffixes(words, np.full(8, 8))
    suffixes = [tuple(words[i:]) for i in s.order]
    for k in range(1, 8):
        a, b = suffixes[k - 1], suffixes[k]
        assert s.shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert len(set(suffixes)) == 8 and (s.place[s.order] == np.arange(8)).all()
    nodes = periodic.small_children(s.shared)
    assert (nodes.start >= nodes.low).all() and (nodes.stop <= nodes.high).all() and (2 * (nodes.stop - nodes.start) <= nodes.high - nodes.low).all()


def test_documents_of_every_shape(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    got = periodic.collapse_runs(docs).collect()
    want = []
    for i, text in docs.select("doc_id", "text").collect():
        words = WORD.findall(text or "")
        runs = brute_runs(words) if len(words) < 1000 else []
        gone = {x for s, k, q in runs for x in range(s + q, s + k)}
        want.append((i, len(words), runs, " ".join(w for x, w in enumerate(words) if x not in gone)))
    assert sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got), key=repr) == sorted(want, key=repr)


def test_query(spark, tmp_path):
    r = random.Random(7)
    texts = [(i, prose(i, r.randint(0, 90)) + "\n" + f" x{i % 3} " * r.randint(0, 30) + "la\tli " * r.choice((0, 0, 12, 13))) for i in range(300)] + [(None, None), (None, "a b " * 15), (400, ""), (5, "q " * 23), (6, "q " * 24)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()]
    want = [brute_row(i, t) for i, t in texts]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 50 and sum(zlib.crc32(str(i).encode()) % 10 == 0 and w[1] > 0 for (i, _), w in zip(texts, want)) > 10


def test_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r) for r in periodic.op11_periodic_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        if len(text) < 8000:
            assert got[i] == brute_row(i, text)


def test_texts_larger_than_a_group(monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", 40)
    monkeypatch.setattr(periodic, "LEAVES", 7)
    texts = [prose(3, 30), "", "a b c " * 9, "x " * 100, prose(4, 5)]
    words, found = periodic.find_in(pa.array(texts))
    low = words.first
    assert found == [(int(low[2]), int(low[3]), 3), (int(low[3]), int(low[4]), 1)]
