import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import brute
from ladderspark.llm import embedding_dedup, fill_middle, importance
from ladderspark.llm.queries import load

SF = "/root/testdata/sf0.001"
QUERIES, _ = load()
VECTORS = "vec_id long, embedding array<float>, label int, extra string, n_links int"


def linked(rows, limit=0.98):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    ok = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) and lab is not None for _, v, lab in rows]
    unit = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if o else None for o, (_, v, _) in zip(ok, rows)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= limit:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(v, least.get(root(i), v))
    return sorted(((v, links[i], least.get(root(i)), v == least.get(root(i))) for i, (v, _, _) in enumerate(rows)), key=str)


def given(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], VECTORS)


def got(frame):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in frame.collect()), key=str)


def around(rng, centre, noise, n):
    return [[float(c) for c in np.float32(centre + rng.normal(size=len(centre)) * noise)] for _ in range(n)]


def test_vectors_of_all_kinds(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    rows = [
        (1, a, 1), (2, b, 1), (3, a, 1), (3, a, 1), (None, a, 1), (4, a, 2), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, [1.0, math.nan, 0.0], 1),
        (10, [math.inf, 0.0, 0.0], 1), (11, a, None), (12, [1.0, 0.0], 1), (13, [2.0, 0.0], 1), (14, [1e30, 0.0, 0.0], 1), (15, [1e-30, 0.0, 1e-32], 1), (None, [0.0, 1.0, 0.0], 1), (16, [-1.0, 0.0, 0.0], 1),
        (17, [0.0, 0.0, 1.0], 3), (17, [0.0, 1.0, 0.0], 3),
    ]
    assert got(embedding_dedup.near_vectors(given(spark, rows))) == linked(rows)
    assert embedding_dedup.near_vectors(given(spark, rows).limit(0)).count() == 0
    assert embedding_dedup.near_vectors(given(spark, rows)).columns == ["vec_id", "n_links", "component_id", "kept"]


@pytest.mark.parametrize("cell,max_pivots", [(40, 4096), (40, 6), (40, 1), (10_000, 4096)])
def test_pivots_and_rings_against_all_pairs(spark, cell, max_pivots):
    """One label holds half of the vectors: a tight cluster, a looser one, chains over several cells, and copies."""
    rng = np.random.default_rng(4)
    chain = [[math.cos(i * 0.15), math.sin(i * 0.15), 0.1, 0.0, 0.0, 0.0] for i in range(40)]
    centre = np.array([0.2, -0.4, 1.0, 0.3, 0.0, 0.5])
    vectors = around(rng, np.zeros(6), 1.0, 250) + chain + around(rng, centre, 0.01, 150) + around(rng, -centre, 0.09, 150) + [chain[7]] * 60
    rows = [(int(i), v, 1) for i, v in zip(rng.permutation(len(vectors)), vectors)] + [(1000 + i, v, i % 3) for i, v in enumerate(around(rng, np.zeros(6), 1.0, 90))]
    random.Random(1).shuffle(rows)
    frame = given(spark, rows).repartition(7)
    assert got(embedding_dedup.near_vectors(frame, cell=cell, max_pivots=max_pivots)) == linked(rows)


def test_vector_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(QUERIES["op11_embedding_dedup"](spark, SF)) == linked(rows)


UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def middle_filled(i, text):
    t = text or ""
    u, sha = UNIT.findall(t), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(sha[j:j + 8], 16) for j in range(0, 32, 8)]
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, t
    low, high = sorted(x % (len(u) + 1) for x in h[:2])
    a, b, c = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    spm = h[3] % 100 < 20
    return len(u), "spm" if spm else "psm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}" if spm else f"<P>{a}<S>{c}<M>{b}"


def test_fill_middle(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", "C", " ", "\n", "é", "漢", "😀", "<", "P>", "<S", ">", "\x00"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = brute.ODD + [(i, t) for i, t in enumerate(texts)] + [(None, "no id at all"), (None, "no id at all"), (5, "a <M> b"), (900020, "long " * 400_000 + "é")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fim_text string, FIM_form int")
    made = fill_middle.transform(docs)
    assert made.columns == docs.columns + ["fim_units", "_fim_form", "fim_prefix", "fim_middle", "_fim_text"]
    back = fill_middle.restore(made, "_fim_text", "_fim_form").collect()
    assert sorted(((r.doc_id, r.text, *r[4:9]) for r in back), key=str) == sorted(((i, t, *middle_filled(i, t)) for i, t in rows), key=str)
    assert all(r.restored == (r.text or "") for r in back) and {r["_fim_form"] for r in back} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.transform(docs.limit(0)), "_fim_text", "_fim_form").count() == 0
    assert len(QUERIES["op12_fill_middle"](spark, SF).collect()) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_rotation():
    for a, b, c in [(0, 0, 6), (0, 6, 6), (1, 3, 6), (2, 2, 2), (0, 5, 6)]:
        buf = bytearray(b"abcdef")
        at = fill_middle.rotate(buf, a, b, c)
        assert buf == b"abcdef"[:a] + b"abcdef"[b:c] + b"abcdef"[a:b] + b"abcdef"[c:] and at == a + c - b


def resampled(rows, target, buckets=importance.BUCKETS, least=importance.LEAST_WORDS):
    feats = [[zlib.crc32(w.encode()) % buckets for w in brute.LICENSE_WORD.findall((t or "").translate(brute.LOWER))] for _, t in rows]
    s = Counter(b for f in feats for b in f)
    t = Counter(zlib.crc32(w.encode()) % buckets for x in target for w in brute.LICENSE_WORD.findall((x or "").translate(brute.LOWER)))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), f in zip(rows, feats):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(order[:len(order) * 10 // 100]):
        r[4] = place + 1
    return sorted(map(tuple, out), key=str)


def test_importance_resampling(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + brute.ODD + [(None, "word " * 30), (-5, "é漢 " * 25 + "\x85  x")]
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, row string, score int")
    out = importance.resample(frame, target).collect()
    assert sorted(map(tuple, out), key=str) == resampled(rows, [r.text for r in target.collect()])
    assert importance.resample(frame.limit(0), target).count() == 0
    assert importance.resample(frame.limit(5), target.limit(0)).count() == 5
    assert len(QUERIES["op13_importance_resampling"](spark, SF).collect()) == docs.count()


def test_many_equal_rows_are_drawn_exactly(spark):
    rows = [(7, "same words " * 20)] * 700 + [(i, f"other text number {i} " * 8) for i in range(300)]
    out = importance.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), spark.createDataFrame([("same",)], "text string")).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 101))
    least = min(r.score for r in out if r["rank"])
    assert all(r.score <= least for r in out if not r["rank"])


@pytest.mark.parametrize("k", [1, 37, 500, 999, 1000])
def test_cutoff_widens_its_bracket(spark, monkeypatch, k):
    monkeypatch.setattr(importance, "SKETCH", 20)
    rng = random.Random(k)
    scores = [(rng.choice([rng.randrange(50), 10, 10_000_000]), i if i % 9 else None, i) for i in range(1000)]
    got_row = importance.cutoff(spark.createDataFrame(scores, "score long, doc_id long, row long"), 1000, k)
    assert tuple(got_row) == sorted(scores, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))[k - 1]


def test_words_of_long_texts_are_listed_in_blocks(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 7)
    text = "Ab,cd  efghijklmnopqrstu é-x " * 5
    assert [w.decode() for part in importance.word_lists(text.encode()) for w in part] == brute.LICENSE_WORD.findall(text.translate(brute.LOWER))
