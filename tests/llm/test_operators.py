import os
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import brute
from ladderspark.llm import bpe, common, exact_dedup, fingerprints, jaccard_join, licenses, lm_scoring, mixing, quality, secret_scan, url_filter
from ladderspark.llm.graph import components
from ladderspark.llm.queries import load

SF = "/root/testdata/sf0.001"
QUERIES, _ = load()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def key(row):
    return tuple((x is None, x) for x in row)


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} >= {f"op{i}" for i in range(1, 14)}


def test_exact_groups(spark, plain, docs, nothing):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in QUERIES["op1_exact_dedup"](spark, SF).collect()]
    assert sorted(got) == brute.exact(plain)
    odd = brute.odd_rows(spark)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(odd).collect()]
    want = brute.exact(brute.ODD)
    assert sorted(r[:3] + r[4:] for r in got) == sorted(r[:3] + r[4:] for r in want)
    assert sum(r[3] for r in got) == sum(r[3] for r in want)
    kept = exact_dedup.distinct_rows(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if r[3])
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.distinct_rows(nothing).count() == 0


def test_exact_group_over_many_partitions(spark):
    rows = [(i, "same  text" if i % 3 else f"other {i}") for i in range(900)] + [(None, "same text"), (5, "sametext")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the partitions apart
    try:
        got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    group = [r for r in got if r.group_size > 1]
    assert len(group) == 602 and {(r.keep_id, r.group_size) for r in group} == {(1, 602)} and sum(r.kept for r in group) == 1
    assert sum(r.kept for r in got) == 301


def test_near_classes(spark, plain, nothing):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op5_jaccard_join"](spark, SF).collect()]
    assert sorted(got) == brute.near(plain)
    odd = brute.odd_rows(spark)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_classes(odd).collect()) == brute.near(brute.ODD)
    assert jaccard_join.near_classes(nothing).count() == 0


A, B = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
NAMELESS = [
    (5, A), (6, A + " more"), (3, B), (5, B.replace("b30", "x30")), (None, A + " end"), (None, A + " end"), (None, "alone in the world of words"), (9, "c d e f g h i"), (9, "c d e f g h i"),
    (None, "null ids that are copies of"), (None, "null ids that are copies of"), (None, ""), (None, None), (12, ""), (5, "some other text with the same id"),
]


def test_near_classes_without_or_with_repeated_ids(spark):
    got = jaccard_join.near_classes(spark.createDataFrame(NAMELESS, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == brute.near(NAMELESS)


@pytest.mark.parametrize("rows", [NAMELESS, [(5, A), (6, A + " more"), (3, B), (5, B + " more")], [(7, A)] * 4, [(None, A)] * 3 + [(None, B)], []])
def test_one_row_of_each_near_class_stays(spark, rows):
    docs = spark.createDataFrame([(i, t, n, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, row_key int, H string")
    left = jaccard_join.without_near_copies(docs)
    assert left.columns == docs.columns
    kept, groups = {r["row_key"] for r in left.collect()}, defaultdict(list)
    for n, (_, g) in enumerate(brute.near_groups(rows)):
        groups[g].append(n)
    for g in groups.values():
        best = min((rows[n][0] is None, rows[n][0] or 0) for n in g)
        assert [(rows[n][0] is None, rows[n][0] or 0) for n in g if n in kept] == [best]


def test_near_classes_of_edited_copies(spark):
    """Chains and texts at the border of the similarity, so that later pivots are needed."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(i % 12):
            w[(i * 7 + j * 11) % 120] = f"x{i}_{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[i * 6:i * 6 + 60])) for i in range(10)]
    got = jaccard_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute.near(rows)


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 3), (None, 4), (7, 8), (8, 9), (9, 7), (20, 21)] + [(i, i + 1) for i in range(100, 140)]
    got = dict(components(spark.createDataFrame(edges, "a int, b int")).collect())
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {i: 100 for i in range(100, 141)}
    assert got == want


def test_fingerprints(spark, plain, nothing):
    rows = plain + [r for r in brute.ODD if r[0] != 900006]
    got = fingerprints.compare_versions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, by_text = brute.versions(rows), {}
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == w[:2]
        assert (r.near_edited, r.near_next) == pytest.approx(w[2:])
        assert by_text.setdefault(text[r.doc_id] or "", r.fingerprint) == r.fingerprint
    assert fingerprints.compare_versions(nothing).count() == 0
    one = fingerprints.compare_versions(brute.odd_rows(spark).where("doc_id = 900006")).collect()
    assert len(one) == 2 and {r.near_next for r in one} == {1.0}


def test_larger_sketch_after_failure(spark):
    rows = [(1, 0, list(range(1000)), list(range(500, 3000))), (2, 0, [], []), (3, 1, [5], [5]), (4, 1, list(range(100)), list(range(1000, 1100)))]
    got = {r.rid: (r.only_first, r.only_second) for r in fingerprints.differences(spark.createDataFrame(rows, "rid long, kind int, a array<long>, b array<long>"), "a", "b").collect()}
    assert got == {1: (500, 2000), 4: (100, 100)} or got == {1: (500, 2000), 2: (0, 0), 3: (0, 0), 4: (100, 100)}


def test_licenses(spark, plain, nothing):
    got = {r.doc_id: r for r in licenses.scan(brute.odd_rows(spark, spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    for i, t in plain + brute.ODD:
        r = got[i]
        want = brute.licenses(t, licenses.PHRASES)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[900015].labels == "apache,mit" and [(s.label, s.edits) for s in got[900015].spans] == [("mit", 1)]
    assert licenses.scan(nothing).count() == 0


@pytest.mark.parametrize("text,label", [
    ("This work is Licenced under the Apache License,\nVersion 2.0", "apache"), ("permision is herby granted, free of charge, to any person", "mit"),
    ("licensed under the GNU Generl Public Licence", "gpl"), ("nothing of the kind", ""),
])
def test_notice_with_edits(text, label):
    found = licenses.Scanner(licenses.PHRASES, licenses.NOTICES).scan(text)
    assert label in found[5].split(",") and (found[7] or not label)
    for s in found[7]:
        assert 0 <= s["start"] < s["end"] <= len(text)


@pytest.mark.parametrize("text,spans", [
    ("all right reserved all rights reserved", [("all-rights-reserved", 0, 18, 1), ("all-rights-reserved", 19, 38, 0)]),
    ("all right reserved all rights reserved all rights reservd", [("all-rights-reserved", 0, 18, 1), ("all-rights-reserved", 19, 38, 0), ("all-rights-reserved", 39, 57, 1)]),
    ("licensed under cc byzantine", []), ("licensed under cc by", [("cc-by", 0, 20, 0)]), ("licensed under cc by nd", [("cc-by", 0, 20, 0)]),
    ("Licenced under CC BY-NC", [("cc-by", 0, 20, 1), ("cc-by-nc", 0, 23, 1)]), ("licensed under cc by sa xyz", [("cc-by", 0, 20, 0), ("cc-by-sa", 0, 23, 0)]),
])
def test_all_notices_of_a_window(text, spans):
    found = licenses.Scanner(licenses.PHRASES, licenses.NOTICES).scan(text)[7]
    assert sorted((s["label"], s["start"], s["end"], s["edits"]) for s in found) == sorted(spans)


def test_many_notices_in_one_window():
    found = licenses.Scanner(licenses.PHRASES, licenses.NOTICES).scan("all right reserved all rights reserved " * 300)[7]
    assert [(s["start"], s["edits"]) for s in found] == [(39 * i + d, e) for i in range(300) for d, e in ((0, 1), (19, 0))]


def test_bpe_is_what_the_tokenizer_gives(spark, plain, nothing):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        codec = bpe.Codec(f.read(), tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    odd = brute.odd_rows(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    back = bpe.decode(bpe.encode(odd, path, tokenizers.PATTERN), path, tokenizers.PATTERN)
    for r in back.collect():
        want = b"".join(i.to_bytes(4, "little") for i in own.encode_ordinary(r.text or ""))
        assert bytes(r.ids) == want and r.n_tokens == len(want) // 4 and r.decoded == (r.text or "")
    assert bpe.round_trip(nothing, path, tokenizers.PATTERN).count() == 0
    assert "".join(codec.decode((50255).to_bytes(4, "little"))) == own.decode([50255], errors="replace")


def test_bpe_on_random_text():
    import random

    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("abcdefgthe  ionrst\n\t0123é漢字😀ß!?.,'s \x1c\x85　²½ः") for _ in range(rng.choice([2, 9, 60])))
        assert codec.encode(t) == b"".join(i.to_bytes(4, "little") for i in own.encode_ordinary(t)), repr(t)


def test_bpe_machine_forgets(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        lines = f.read()
    text = " unbelievably transdeterminised counterrevolutionaries xyzzyqwop" * 3
    whole = bpe.Codec(lines, tokenizers.PATTERN).encode(text)
    monkeypatch.setattr(bpe, "MAX_STATES", 7)
    monkeypatch.setattr(bpe, "MAX_WORDS", 2)
    assert bpe.Codec(lines, tokenizers.PATTERN).encode(text) == whole


def test_mixing(spark, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = brute.odd_rows(spark, docs)
    got = mixing.mix(odd).collect()
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    text = defaultdict(list)
    for r in odd.collect():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
        text[r.doc_id].append(len(brute.WORD.findall(r.text or "")))
    for r in got:
        assert r.size in text[r.doc_id] and r.source_size == sizes[r.source] and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert target == pytest.approx(brute.targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes)
    assert sorted(mixing.mix(odd).collect()) == sorted(got) if None not in sizes else True
    rows = mixing.mixed_rows(brute.odd_rows(spark))
    assert rows.columns == brute.odd_rows(spark).columns
    assert sum(len(brute.WORD.findall(r.text or "")) for r in rows.collect()) == sum(r.taken for r in mixing.mix(brute.odd_rows(spark)).collect())
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0


def test_secrets(spark, plain, nothing):
    got = {r.doc_id: r for r in secret_scan.scan(brute.odd_rows(spark, spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    for i, t in plain + brute.ODD:
        assert [(s.start, s.kind, s.end) for s in got[i].base] == brute.secrets(t), i
        assert {tuple(s) for s in got[i].base} <= {tuple(s) for s in got[i].spans}
    assert secret_scan.scan(nothing).count() == 0
    digest = QUERIES["op10_secret_scan"](spark, SF).collect()
    assert len(digest) == len(plain) and {len(r.base_sha256) for r in digest} == {64}


def test_weak_parts_need_each_other(spark):
    rows = [(1, "user: bob at https://db.example.org/x pwd=hunter22xx"), (2, "pwd=hunter22xx" + " z" * 300 + "https://a.b/c"), (3, "pwd=hunter22xx"), (4, "see https://a.b/c"), (5, "user=bob secret=abcdefghijklmnopq")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [3, 5, 4], 2: [], 3: [], 4: [], 5: [3, 0]}


def test_parts_of_one_credential_are_linked(spark):
    hexed, long_url = "0123456789abcdef" * 2, "https://a.b/" + "-" * 600
    rows = [
        (1, "username: alice / password: hunter22 / https://db.example.com/login"), (2, f"client_id: {hexed} / client_key: Zx9QwErTy7"),
        (3, "https://db.example.com/?token=abcdefghijklmnop pass: Zx9QwErTy7"), (4, long_url + " pwd=hunter22xx"), (5, "pwd=hunter22xx " + long_url + " user=bob"),
        (6, "user=bob" + " " * 256 + "pwd=hunter22xx"), (7, "user=bob" + " " * 257 + "pwd=hunter22xx"), (8, "pwd=" + "Q" * 300 + " " * 256 + "user=bob"), (9, "token: hunter22"),
        (10, "login=root DB_PASSWORD='root'"), (11, f"client_id: {hexed}"), (12, None),
    ]
    got = {r.doc_id: [(s.kind, dict(rows)[r.doc_id][s.start:s.end]) for s in r.spans] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pwd, bob, url = (4, "pwd=hunter22xx"), (3, "user=bob"), (5, long_url)
    assert got == {
        1: [(3, "username: alice"), (4, "password: hunter22"), (5, "https://db.example.com/login")], 2: [(2, hexed), (4, "client_key: Zx9QwErTy7")],
        3: [(0, "token=abcdefghijklmnop"), (4, "pass: Zx9QwErTy7")], 4: [url, pwd], 5: [pwd, url],
        6: [bob, pwd], 7: [], 8: [(4, "pwd=" + "Q" * 300), bob], 9: [], 10: [(3, "login=root"), (4, "PASSWORD='root")], 11: [(2, hexed)], 12: [],
    }


def test_linked_parts_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    pieces = ["user=bob", "pwd=hunter22xx", "https://a.b/c", "secret=abcdefghijklmnopq", "token: abc", "AKIA" + "B" * 16, "f" * 20, "https://c.d/" + "-" * 400, "pwd=" + "-" * 350]
    rows = [(i, "".join(rng.choice(pieces) + " " * rng.choice([1, 200, 250, 256, 257, 300, 520]) for _ in range(rng.randrange(2, 8)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = {r.doc_id: [(*b, False) for b in r.base] + [tuple(w) for w in r.weak] for r in secret_scan.found_parts(docs).collect()}
    near = lambda a, b: max(a[0] - b[2], b[0] - a[2]) <= secret_scan.SCOPE and (a[1] in (0, 2, 4)) != (b[1] in (0, 2, 4))
    for r in secret_scan.scan(docs).collect():
        want = [a[:3] for a in parts[r.doc_id] if a[1] < 3 or a[3] and any(near(a, b) for b in parts[r.doc_id])]
        assert [tuple(s) for s in r.spans] == sorted(want)


def test_url_filter(spark):
    rows = [
        (1, "http://a.example.net/x", '<link rel="canonical" href="http://b.net/y">'), (2, "http://b.net/y#q", '<META http-equiv="refresh" content="0; url=http://shop.com/de/z">'),
        (3, "https://SHOP.com/de/z#t", None), (4, "http://x.example.org/en/22", '<link href="/es/1" rel=canonical>'), (5, None, None), (6, "noscheme", ""),
        (7, "http://c.net", "<link rel='canonical' href='//x.example.org/es/1'>"), (8, "http://lonely.net/a?b", None), (9, "http://x.org?a/b", ""), (10, "http://x.example.org/en/1/b", ""), (10, "http://x.example.org/en/1/b", ""),
        (11, "http://old.net/1", ""),
    ]
    moved = spark.createDataFrame([("http://old.net/1", "http://mid.net/"), ("http://mid.net/", "http://c.com/de/")], "from_url string, to_url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), moved).collect()}
    assert {k: v[3] for k, v in got.items() if v[3] == "block"}.keys() == {1, 2, 3, 7, 10, 11}
    assert got[3][:3] == ("shop.com", "/de/z", "com/de/") and got[4] == ("x.example.org", "/en/22", "org/", "allow") and got[5] == ("", "", None, "allow")
    assert got[9][:3] == ("x.org", "", None) and got[10][2] == "example.org/en/1"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    for r, p in zip(*[sorted(x, key=lambda y: y.page_id) for x in (QUERIES["op7_url_filter"](spark, SF).collect(), spark.read.parquet(f"{SF}/pages.parquet").collect())]):
        rest = p.url.split("://", 1)[1]
        host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
        path = rest[len(host):].split("?")[0].split("#")[0]
        fit = next((q for q in rules if (host == q[1] or host.endswith("." + q[1])) and path.startswith(q[2])), None)
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[1] + fit[2]) and (fit is None or r.verdict == fit[0])


def test_link_targets(spark):
    at, to = "http://S.net/a/b?q=1#f", lambda href: f"<link rel='canonical' href=\"{href}\">"
    rows = [
        (at, to("login.html"), "s.net/a/login.html"), (at, to("?id=3"), "s.net/a/b?id=3"), (at, to("/x"), "s.net/x"), (at, to("//T.net"), "t.net/"), (at, to("#top"), "s.net/a/b?q=1"),
        (at, to("../c/./d/.."), "s.net/c/"), (at, to("/../../e"), "s.net/e"), (at, to("go?u=http://evil.net/"), "s.net/a/go?u=http://evil.net/"), (at, to("mailto:bob@x.net"), None), (at, "<link rel=canonical>", None),
        (at, to("https://t.net/z?a=1&amp;b=2&#38;c=3&#x26;d"), "t.net/z?a=1&b=2&c=3&d"), (at, to("/?a&amp;amp;b&copy=1&nosuch;&#233;&#x1F600;&#x110000;&#99999999999;"), "s.net/?a&amp;b&copy=1&nosuch;é😀\ufffd\ufffd"),
        ("http://s.net", to("item2"), "s.net/item2"), ("http://s.net?q", to("?r"), "s.net/?r"), ("noscheme", to("item2"), None), (at, '<base href="/v/w"><meta http-equiv=refresh content="0; url=item">', "s.net/v/item"),
        (at, '<meta property="og:url" content="./item&#x2F;3">', "s.net/a/item/3"),
    ]
    got = spark.createDataFrame([r[:2] for r in rows], "url string, html string").select(url_filter.targets(F.col("url"), F.col("html"))).collect()
    assert [list(r[0]) for r in got] == [[r[2]] if r[2] else [] for r in rows]


def test_blocks_reach_aliases(spark):
    to = lambda href: f'<link rel="canonical" href="{href}">'
    rows = [
        (1, "https://shop.com/de/z?a=1&b=2", ""), (2, "http://x.net/1", to("https://shop.com/de/z?a=1&amp;b=2")), (3, "http://y.net/d/e", to("item2")), (4, "http://y.net/d/item2", to("http://x.net/1")),
        (5, "http://z.net", ""), (6, "http://z.net/k", to("http://z.net/")), (7, "http://z.net/l", to("http://z.net")), (8, "http://z.net/", to("//y.net/d/e")), (9, "http://other.net/k", to("l")), (10, "http://w.net/a/1", ""),
    ]
    moved = spark.createDataFrame([("http://w.net/a/1", "../b"), ("http://w.net/b", "http://z.net")], "from_url string, to_url string")
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), moved).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 10}


def test_quality_on_held_out_rows(spark, nothing):
    sf = SF.replace("0.001", "0.01")
    got = QUERIES["op9_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_quality_without_labels(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(nothing, labels).count() == 0
    got = quality.classify(brute.odd_rows(spark), labels).collect()
    assert len(got) == len(brute.ODD) and {r.score for r in got} == {0.5}


def test_line_field_marginals():
    """Forward and backward against the sum over all labellings."""
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(1)
    field = quality.LineField(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2)), 1.0, 0.0)
    x = rng.normal(size=(5, quality.WIDTH))
    odds = x @ field.line
    total, good = 0.0, np.zeros(5)
    for y in product((0, 1), repeat=5):
        w = np.exp(sum(odds[i] for i in range(5) if y[i]) + sum(field.step[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    assert field.good_lines(x) == pytest.approx(good / total)


def test_lm_scores(spark, plain, nothing):
    rows = plain + brute.ODD + [(None, "x y")]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = lm_scoring.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    want = brute.losses(rows, target, lm_scoring.ALPHA)
    assert len(got) == len(want)
    for a, b in zip(sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in got), key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and a[2:4] == (b[2:] if b[2] is None else pytest.approx(b[2:], abs=1e-3))
        assert a[4] is None if b[2] is None else a[4] == pytest.approx(b[2] - b[3], abs=2e-3)
    assert lm_scoring.cross_entropy_difference(nothing, nothing).count() == 0
    assert len(QUERIES["op6_lm_scoring"](spark, SF).collect()) == len(plain)


def test_no_other_part_imports_the_subpackage():
    top = os.path.dirname(os.path.dirname(common.__file__))
    for folder, _, files in os.walk(top):
        for f in files:
            if f.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(os.path.join(folder, f)) as text:
                    assert "llm" not in text.read(), f
