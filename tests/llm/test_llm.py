"""The training-data operators against plain versions, on small and odd tables."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import byte_bpe, jaccard_join, lm_scoring, packing, quality_rules, sharding, suffix_dedup, token_counts, topk_search, url_filter
from quillgraph.operators.graph import components

WORDS = ["the", "and", "éa", "on", "The", "xo", "日本", "don't", "x²", "<|endoftext|>", "__", "ﬁ"]


def make(seed=1, n=40):
    rng = random.Random(seed)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))
    base = text() + " " + text() + " " + text()
    rows = [(i, text()) for i in range(n)] + [(100, None), (101, ""), (102, " \n\t"), (None, base), (103, base), (103, base), (104, base), (105, base + " end"), (106, "a" * 3000), (107, "x y " * 2000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "cls": F.lit(1), "lang": F.lit("en")}).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def collected(df):
    return [r.asDict() for r in df.collect()]


def bare(rows):
    return sorted(((i, (t or "").encode()) for i, t in rows), key=repr)


def test_byte_bpe(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.RANKS), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), hashlib.sha256(np.array(plain.encode_ordinary(t.decode()), "<u4").tobytes()).hexdigest(), hashlib.sha256(t).hexdigest()) for i, t in bare(make()))
    found = collected(byte_bpe.byte_bpe(docs))
    assert sorted((str(r["doc_id"]), r["ids_sha256"], r["decoded_sha256"]) for r in found) == want
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in found)
    assert byte_bpe.byte_bpe(empty).count() == 0


def test_byte_bpe_long_words():
    codec = byte_bpe.codec(P.path(byte_bpe.RANKS), P.PATTERN)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.RANKS), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    words = ["a" * n for n in (1, 2, 3, 63, 64, 65, 200)] + ["".join(rng.choice("theraning") for _ in range(900)) for _ in range(3)] + ["=-" * 100 + "=" * 33]
    assert codec.encode([w.encode() for w in words]) == [np.array(plain.encode_ordinary(w), "<u4").tobytes() for w in words]


def test_topk_search(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)] + [(300, None), (301, [1.0] * 7 + [None]), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, [1.0, 2.0]), (305, []), (None, [0.0] * 8), (7, rng.normal(size=8).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    found = collected(topk_search.topk_search(table.where("vec_id % 100 = 0"), table, k=5, cand_block=64, query_block=2))
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in {i: v for i, v in good if i % 100 == 0}.items():
        best = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != q and len(w) == len(v)))[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == [(j, -s) for s, j in best]
    assert topk_search.topk_search(table.where("false"), table).count() == 0


def test_topk_search_of_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * (1 if i % 3 else 10.0 ** (i % 5 + 2))).tolist()) for i in range(200)]
    rows += [(i, [2.0**20] * 7 + [(i % 7) / 1024]) for i in range(200, 230)]  # scores differ beyond a double's digits
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collected(topk_search.topk_search(table.where("vec_id % 10 = 0"), table, k=5, cand_block=64, query_block=4))
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for q in range(0, 230, 10):
        best = sorted((-sum(a * b for a, b in zip(whole[q], w)), j) for j, w in whole.items() if j != q)[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == [(j, -s) for s, j in best]


def test_packing(docs, empty):
    library = Tokenizer.from_file(P.path(packing.VOCABULARY))
    want = Counter((str(i), np.array([*library.encode(t.decode(), add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in bare(make()))
    found = collected(packing.pack(docs, limit=256))
    assert len({r["sequence_id"] for r in found}) == len(found) and {r["offset"] for r in found} == {0}
    assert all(r["length"] in [1 << i for i in range(9)] and len(r["ids"]) == 4 * r["length"] for r in found)
    again, held = Counter(), b""
    for r in sorted(found, key=lambda r: r["sequence_id"]):
        held += r["ids"]
        if len(held) == 4 * r["doc_tokens"]:
            again[str(r["doc_id"]), held] += 1
            held = b""
    assert again == want
    assert packing.piece_lengths(0) == [] and packing.piece_lengths(4096 + 5) == [4096, 4, 1]
    assert packing.pack(empty).count() == 0


URLS = ["https://www.spam-farm.example.org/en/2?x", "http://A.Example.COM/en/71", "http://x.net/de/8", "http://q.example.net/de/88#a", "https://ok.org/fr/", "https://notspam-farm.example.org/", None, "no scheme", "ftp://", "http://org/es/", "http://com/en/"]


def test_url_filter(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([(k,) for k in (*url_filter.LISTED, None)], "key string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed).collect()}
    assert found[0] == ("www.spam-farm.example.org", "/en/2", None, "block")
    assert found[1] == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert found[2][2:] == ("net/de/", "allow") and found[3][2:] == ("example.net/de/8", "block")
    assert found[5][2:] == (None, "allow") and found[6] == ("", "", None, "allow") == found[7]
    assert found[9][2:] == ("org/es/", "block") and found[10][2:] == ("com/en/", "block")
    assert url_filter.filter_urls(pages.where("false"), listed).count() == 0
    assert url_filter.filter_urls(pages, listed.where("false")).where("listed").count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("key like '%7'").union(spark.createDataFrame([("elsewhere",)], "key string"))
    levels = url_filter.build_cascade(universe, listed)
    wrong = universe.where(url_filter.is_listed(levels, F.col("key")) != F.col("key").endswith("7"))
    assert len(levels) > 1 and wrong.count() == 0


def test_suffixes():
    rng = random.Random(2)
    for _ in range(10):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(8)]
        string, length, common = suffix_dedup.sorted_suffixes(strings)
        want = sorted((s[len(s) - k :], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
        assert [(int(i), int(k)) for i, k in zip(string, length)] == [(i, k) for _, i, k in want]
        for a, b, n in zip(want, want[1:], common[1:]):
            shared = next((j for j in range(min(len(a[0]), len(b[0]))) if a[0][j] != b[0][j]), min(len(a[0]), len(b[0])))
            assert shared == n


def plain_dedup(rows, width=50):
    first = {}
    big = lambda i: float("inf") if i is None else i
    for i, t in sorted(rows, key=lambda r: big(r[0])):
        for j in range(len(t) - width + 1):
            first.setdefault(t[j : j + width], big(i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - width + 1):
            if first[t[j : j + width]] < big(i):
                gone[j : j + width] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        out.append((str(i), len(t), int(gone.sum()), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


def test_suffix_dedup(docs, empty):
    found = collected(suffix_dedup.suffix_dedup(docs, batch_bytes=2000))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in found) == plain_dedup(bare(make()))
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in found)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffixes_of_several_rounds():
    rng = random.Random(5)
    for alphabet in (b"a", b"ab", b"\x00ab\xfe"):
        strings = [bytes(rng.choice(alphabet) for _ in range(n)) for n in (0, 7, 8, 9, 16, 30, 99)]
        want = sorted((s[len(s) - k :], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
        shared = lambda a, b: next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        for least in (0, 10):
            string, length, common = suffix_dedup.sorted_suffixes(strings, least)
            assert [(int(i), int(k)) for i, k in zip(string, length)] == [(i, k) for _, i, k in want]
            assert common[1:].tolist() == [shared(a[0], b[0]) if min(a[2], b[2]) >= least else 0 for a, b in zip(want, want[1:])]


def test_suffix_dedup_by_slices(spark):
    """No slice of anchors goes through the driver by a job of its own, and texts stay in
    their buckets: both grew with the input."""
    rng = random.Random(6)
    texts = [" ".join(str(rng.random()) for _ in range(30)) for _ in range(40)]
    rows = [*enumerate(texts), *((40 + i, t[60:300]) for i, t in enumerate(texts[:9])), (None, texts[3])]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        spark.sparkContext.setJobGroup("slices", "")
        found = suffix_dedup.suffix_dedup(docs, batch_bytes=2000)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("slices")) < 10
        assert found._jdf.queryExecution().executedPlan().toString().count("Bucketed: true") == 2
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found.collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == plain_dedup([(i, t.encode()) for i, t in rows])


def test_lm_scoring(docs, empty):
    rows = bare(make())
    trained = tuple(t for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1)
    counts = Counter(w for t in trained for w in t.translate(lm_scoring.LOWER).split())
    n, v = sum(counts.values()) + len(trained), len(counts) + 1
    want = []
    for i, t in rows:
        base = math.log10((len(trained) + 0.5) / (n + 0.5 * (v + 1))) + sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t.translate(lm_scoring.LOWER).split())
        want.append((str(i), base, lm_scoring.adaptive_code_length(t, trained=trained, learn=False)))
    found = sorted((str(r["doc_id"]), r["base_score"], r["score"]) for r in collected(lm_scoring.score_documents(docs, batch_bytes=4000)))
    for a, b in zip(sorted(want), found, strict=True):
        assert a[0] == b[0] and b[1:] == pytest.approx(a[1:], rel=1e-4)
    assert lm_scoring.score_documents(empty).count() == 0


def test_sharding(docs, empty):
    found = collected(sharding.shard_rows(docs, shards=3, rounds=3))
    sizes = Counter(r["shard"] for r in found)
    assert len(found) == len(make()) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    want = Counter((str(i), len(t) + 1, zlib.crc32(t)) for i, t in bare(make()))
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == want
    assert sharding.shard_rows(empty).count() == 0


def test_quality(docs, empty):
    prose = "The house stood on the hill and many people came to see it before the winter set in and closed the road. " * 1
    rows = [(1, " ".join(f"{w}" for w in (prose + prose.replace("house", "barn").replace("many", "few").replace("winter", "spring").replace("people came", "birds flew")).split()), "en"), (2, "a " * 60, "en"), (3, None, None), (4, "### $$$ | *** | &&& | %%% | #a $b %c &d <e> |f| #g $h %i &j " * 9, "en")]
    found = {r.doc_id: r for r in quality_rules.quality(docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert found[2].base_failed and found[2].n_repeat_words == 60 and not found[3].kept and not found[4].kept
    for r in collected(quality_rules.quality(docs)):
        assert r["n_words"] >= 0 and r["kept"] in (True, False)
    index = np.array([1, 2, 3, 1, 2, 3, 9])
    assert quality_rules.repeated(index) == 6 and quality_rules.repeated(index[:2]) == 0
    assert quality_rules.quality(empty).count() == 0


def test_quality_bands(spark):
    """The bands follow their rule; on labels held out, they lose little and keep little junk."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    figures = quality_rules.quality(docs.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8)).persist()
    for r in quality_rules.lower_bounds(figures, labels).collect():
        assert quality_rules.BANDS[r.band].letters_per_token[0] == r.least
    held_out = figures.where("not base_failed and doc_id % 2 = 1").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.quality: r.kept for r in held_out.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.1


def plain_components(rows):
    sets = []
    for i, t in rows:
        ws = t.translate(jaccard_join.LOWER).split()
        k = min(5, len(ws))
        sets.append(frozenset(tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)) if ws else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        groups[find(x)].append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted((str(i), len(sets[x]), str(least[find(x)] if sets[x] else i)) for x, (i, _) in enumerate(rows))


def test_jaccard_join(spark, docs, empty):
    rng = random.Random(5)
    base = [f"w{j}" for j in range(120)]
    near = [(1000 + i, " ".join(w if rng.random() > 0.01 else f"n{i}{w}" for w in base).encode()) for i in range(90)]
    rows = bare(make()) + near
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(i, t.decode()) for i, t in near], "doc_id long, text string"))
    found = collected(jaccard_join.similar_components(table, long=16, frequent=4))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == plain_components(rows)
    assert jaccard_join.similar_components(empty).count() == 0
    kept = collected(jaccard_join.one_of_each(docs))
    assert [r["doc_id"] for r in kept].count(103) == 1 and not {None, 104} & {r["doc_id"] for r in kept}


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    want = sorted((str(i), len(t), count(t.decode())) for i, t in bare(make()))
    found = collected(token_counts.token_counts(docs, budget=20, prefixes=True))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == want
    texts = {i: t or "" for i, t in make()}
    for r in [r for r in found if r["doc_id"] is not None and r["doc_id"] < 12]:
        counts = [count(texts[r["doc_id"]][:j]) for j in range(len(texts[r["doc_id"]]) + 1)]
        assert r["prefix_counts"] == counts and r["fit_chars"] == max(j for j, c in enumerate(counts) if c <= 20)
    assert token_counts.token_counts(empty).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (5, 5)], "x long, y long")
    assert {tuple(r) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (9, 8), (8, 8)}
