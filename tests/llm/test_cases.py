"""Odd rows for every operator, and plain versions of what has no SQL."""

import base64
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillgraph.llm import byte_bpe, jaccard_join, packing, quality_rules, sharding, suffix_dedup, token_counts, topk_search, url_filter
from quillgraph.llm.common import WORD
from tests.llm.test_llm import bare, collected, make, plain_components, plain_dedup


@pytest.fixture(scope="module")
def clashing(spark):
    """Rows with columns named like what operators make on the way."""
    names = ["kept", "band", "n_words", "empty", "gone", "cls", "root", "slice", "x0", "c0", "d0", "carried_0", "node", "hub", "shard", "slot", "row", "salt", "members", "batch", "length", "start", "ids", "n_tokens"]
    return spark.createDataFrame(make(3), "doc_id long, text string").withColumns({n: F.lit(f"own {n}") for n in names}).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).repartition(3).persist()


def test_clashing_columns_stay(clashing):
    others = [c for c in clashing.columns if c not in ("doc_id", "text", "n_chars")]
    for stage in (quality_rules.kept_rows, jaccard_join.one_of_each, suffix_dedup.without_repeats):
        found = stage(clashing)
        assert found.columns == clashing.columns and found.schema.simpleString() == clashing.schema.simpleString()
        assert all(r[c] == ("en" if c == "lang" else f"own {c}") for r in found.collect() for c in others)
        assert stage(clashing.where("false")).count() == 0
    for operator in (quality_rules.quality, jaccard_join.similar_components, suffix_dedup.suffix_dedup, sharding.shard_rows, packing.pack, token_counts.token_counts, byte_bpe.byte_bpe):
        assert operator(clashing).count() > 0


def test_without_repeats_keeps_nulls(clashing):
    found = {(r.doc_id, r.text) for r in suffix_dedup.without_repeats(clashing).collect()}
    assert (100, None) in found and (101, "") in found
    kept = {}
    for (i, t), (_, _, _, _, left) in zip(sorted(((str(i), t) for i, t in bare(make(3)))), plain_dedup(bare(make(3))), strict=True):
        kept.setdefault(i, Counter())[left.decode("utf-8", "ignore")] += bool(left) or not t
    for i, t in found:
        assert kept[str(i)][t or ""] or t is None


def prefix_counts(library, text):
    return [len(library.encode(text[:j], add_special_tokens=False).ids) for j in range(len(text) + 1)]


def test_prefixes_of_decomposed_text():
    library = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    counter = token_counts.PrefixCounter(P.path(token_counts.VOCABULARY))
    rng = random.Random(3)
    pieces = ["e\u0301", "o\u0308", "x\u0301", "\u0130", "a", "b", "'", "s", "re", "ll", "1", "!", "\u00e9", "\uac00", "\u1100\u1161\u11a8", "\u1100", "\ufb01", "A\u030a", "\u212b", "日本", "<|endoftext|>", "\u2003", "Σ", "\u0327\u0301", "q\u0323\u0307", "_", "🙂", " "]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 24)))
        assert counter.prefix_counts(text.encode()).tolist() == prefix_counts(library, text), repr(text)
    text = unicodedata.normalize("NFD", "".join(rng.choice("éàüñabcdefghijklmnopqrstuvwç") for _ in range(200_000)))
    found = counter.prefix_counts(text.encode())
    assert len(found) == len(text) + 1 and found[-1] == counter.counts([text.encode()])[0][1][-1]
    for j in rng.sample(range(len(text)), 5):
        assert found[j] == len(library.encode(text[:j], add_special_tokens=False).ids)


def test_long_words_whose_merges_make_lower_ranks():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.RANKS), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [w for w, k in ranks.items() if len(w) > 2 and w.isalpha() and w.isascii() and any(w[i:] in ranks and w[:i] in ranks and max(ranks[w[i:]], ranks[w[:i]]) > k for i in range(1, len(w)))]
    rng = random.Random(5)
    words = []
    for _ in range(1500):
        parts = [p for w in (rng.choice(odd).decode() for _ in range(3)) for p in (w, w[:1], w[1:], w[:-1], w[-1:])]
        words.append("".join(rng.choice(parts) * rng.randint(1, 3) for _ in range(rng.randint(10, 40))))
    codec = byte_bpe.codec(P.path(byte_bpe.RANKS), P.PATTERN)
    assert codec.contracted(words, byte_bpe.STRETCH) == [np.array(plain.encode_ordinary(w), "<u4").tobytes() for w in words]


def test_very_long_texts(spark):
    """A megabyte of words, one without a space, and one of a single letter."""
    rng = random.Random(8)
    words = " ".join("".join(rng.choice("abcdeghilnorstu") for _ in range(rng.randint(2, 9))) for _ in range(160_000))
    rows = [(1, words), (2, words[:400_000].replace(" ", "")), (3, "z" * 300_000), (4, words[500_000:]), (5, words[500_000:] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).persist()
    library = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.RANKS), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = byte_bpe.byte_bpe(docs.where("doc_id <> 2")).collect()
    assert {r.doc_id: r.ids for r in found} == {i: bytearray(np.array(plain.encode_ordinary(t), "<u4").tobytes()) for i, t in rows if i != 2}
    removed = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs.where("doc_id <> 3")).collect()}
    assert removed[1] == 0 and removed[4] == len(rows[3][1]) and removed[5] == len(rows[3][1])
    linked = {r.doc_id: r.component_id for r in jaccard_join.similar_components(docs).collect()}
    assert linked[5] == 4 and linked[1] == 1
    assert {r.doc_id: r.n_words for r in quality_rules.quality(docs.where("doc_id in (1, 3)")).collect()} == {1: 160_000, 3: 1}


def test_ties_of_scores(spark):
    """Equal vectors in several blocks: ties go to smaller ids; rows that occur twice count twice."""
    rows = [(i, [1.0, float(i % 2)]) for i in range(60)] + [(3, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collected(topk_search.topk_search(table.where("vec_id % 20 = 0"), table, k=4, cand_block=8, query_block=1))
    for q in (0, 20, 40):
        best = sorted((-(1024 * 1024 * (1 + 0 * v[1])), j) for j, v in rows if j != q)[:4]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == [(j, -s) for s, j in best]


def test_lists_hold_all_that_scores_need():
    """Scores come from the sorted lists alone: the vectors are gone by then."""
    rng = np.random.default_rng(1)
    c = np.floor(rng.normal(size=(300, 6)) * 100)
    q = np.floor(rng.normal(size=(9, 6)) * 100)
    lists = topk_search.Lists(c)
    assert (lists.values[:6] == np.sort(c, axis=0)[::-1].T).all() and (lists.values[6:] == np.sort(c, axis=0).T).all()
    for d in range(12):
        assert (lists.values[d, lists.depth[d]] == lists.held[d]).all()
    found = topk_search.nra(np.arange(1000, 1009), q, np.arange(300), lists, 5, False)
    for i in range(9):
        best = np.lexsort((np.arange(300), -(c @ q[i])))[:5]
        assert found[1][found[0] == 1000 + i].tolist() == best.tolist() and found[2][found[0] == 1000 + i].tolist() == (c @ q[i])[best].tolist()


def test_rules_of_equal_length(spark):
    pages = spark.createDataFrame([(1, "x://a.b.com/pq"), (2, "x://c.com/p")], "page_id long, url string")
    rules = (("allow", "com/pq"), ("block", "com/pq"), ("block", "b.com/"), ("allow", "com/p"))
    listed = spark.createDataFrame([], "key string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, rules).collect()}
    assert found == {1: ("b.com/", "block"), 2: ("com/p", "allow")}


def groups_cut(rows):
    """(pairs of equal texts in different shards, groups that are split)."""
    shards = defaultdict(Counter)
    for text, shard in rows:
        shards[text][shard] += 1
    pairs = sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in shards.values())
    return pairs, {t for t, c in shards.items() if len(c) > 1}


def test_sharding_cuts_little(spark):
    """Groups below a shard's size are whole; one above goes to as few shards as its
    size takes, and the rest fill up."""
    rng = random.Random(2)
    texts = [f"t{i}" for i in range(500)] + [f"pair {i}" for i in range(120) for _ in range(2)] + [f"some {i}" for i in range(12) for _ in range(9)] + ["large"] * 700 + ["wide"] * 90 + [None] * 3
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = collected(sharding.shard_rows(docs))
    sizes = Counter(r["shard"] for r in found)
    assert sum(sizes.values()) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in enumerate(texts))
    pairs, split = groups_cut((texts[r["doc_id"]], r["shard"]) for r in found)
    assert split <= {"large", "wide"}
    quota = len(texts) // 8
    full, rest = divmod(700, quota)
    assert pairs <= 1.15 * ((700**2 - full * quota**2 - rest**2) // 2) + 90**2 // 2


def test_every_group_of_the_table_is_propagated(spark, monkeypatch, caplog):
    """Each row that has an equal is in a node; links are cut at first, and none at the end."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").persist()
    seen, plain = [], sharding.propagate
    monkeypatch.setattr(sharding, "propagate", lambda nodes, *a: seen.append(nodes.agg(F.count_distinct("node.hub"), F.count(F.lit(1)), F.sum("weight")).head()) or plain(nodes, *a))
    caplog.set_level("INFO", logger=sharding.__name__)
    shard = {r.doc_id: r.shard for r in sharding.shard_rows(docs).collect()}
    rows = docs.collect()
    groups = {t: n for t, n in Counter(r.text for r in rows).items() if n > 1}
    assert seen[0][0] == len(groups) > 20 and seen[0][2] == sum(groups.values()) and seen[0][1] > len(groups)
    assert int(re.search(r"from (\d+) to", caplog.text)[1]) > len(groups) / 2
    pairs, split = groups_cut((r.text, shard[r.doc_id]) for r in rows)
    assert not pairs and not split


def plain_quality(text):
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.split()]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return (len(words), sum(len(w.decode()) for w in words), sum(data.count(c.encode()) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + make(4) + [(500, "a\n\na\n \nb\na"), (501, "x y x y x y\x0bx\x1cy #|<>"), (502, "é\u00a0ü " * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality(table).collect())
    assert found == Counter((i, *plain_quality(t)) for i, t in rows)
    assert WORD == "[^\\x20\\x09-\\x0D]+"


def plain_vocabularies():
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path(quality_rules.VOCABULARY))
    with open(P.path(quality_rules.OTHER), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return pieces, tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_figures(text, lang, pieces, other):
    """n_tokens, characters a token under both vocabularies, letters a token, fallback
    share, entropy, band and verdict, a word at a time."""
    words = [w.decode() for w in (text or "").encode().split()]
    ids = [i for w in words for i in pieces.encode(w)]
    n, chars, n_other = len(ids), sum(map(len, words)), sum(len(other.encode_ordinary(f" {w}")) for w in words)
    shares = [c / n for c in Counter(ids).values()]
    per = [x / y if y else 0.0 for x, y in ((chars, n), (chars, n_other), (sum(c.isalnum() for w in words for c in w), n), (sum(map(pieces.is_byte, ids)), n))]
    entropy = -math.fsum(p * math.log2(p) for p in shares)
    wide = sum(ord(c) > 0x7FF for c in text or "")
    name = lang if lang in quality_rules.BANDS else "latin" if 2 * wide < chars else "other"
    band = quality_rules.BANDS[name]
    fits = all(low <= x <= high for x, (low, high) in zip(per, (band.chars_per_token, band.other_chars_per_token, band.letters_per_token), strict=False))
    return (n, *per, entropy), name, fits and per[3] <= band.most_fallback and entropy >= band.least_entropy and not plain_quality(text)[-1]


def test_fertility_against_a_plain_version(spark):
    """Every document of sf0.001, and texts of other scripts, symbols and odd spaces."""
    words = "слово дом река 東京都 数据 مرسوم قانون 🙂🙂 ½x naïve a\u0301 \ud7ff \u0800 x\u00a0y #|<> 12,5 \x1c ﬁ".split(" ")
    rng = random.Random(8)
    odd = [" ".join(rng.choices(words[a:b], k=80)) for a, b in ((0, 3), (3, 5), (5, 7), (7, 18), (0, 18))]
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000 + i, t, lang) for i, (t, lang) in enumerate((t, lang) for t in [*odd, "", None, " \n\t", rows[0][1]] for lang in (None, "en", "xx"))]
    vocabularies = plain_vocabularies()
    found = {r.doc_id: r for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert len(found) == len(rows)
    for i, text, lang in rows:
        r = found[i]
        figures, name, kept = plain_figures(text, lang, *vocabularies)
        assert (r.n_tokens, r.chars_per_token, r.other_chars_per_token, r.letters_per_token, r.fallback_share, r.token_entropy) == pytest.approx(figures, abs=1e-9)
        assert (r.band, r.kept) == (name, kept)
    assert {r.band for r in found.values()} >= {"en", "latin", "other"}


def test_bounds_of_characters_follow_their_rule(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    figures = quality_rules.quality(docs.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8))
    for r in quality_rules.lower_bounds(figures, labels).collect():
        band = quality_rules.BANDS[r.band]
        assert (band.chars_per_token[0], band.other_chars_per_token[0]) == (r.least_chars, r.least_other_chars)


def test_bounds_of_places():
    """The bound on a first match, against all pairs of small sets."""
    rng = random.Random(4)
    for _ in range(300):
        a, b = (set(rng.sample(range(30), rng.randint(1, 20))) for _ in range(2))
        a, b = sorted(a), sorted(b)
        both = set(a) & set(b)
        if 100 * len(both) >= 80 * len(set(a) | set(b)):
            for n, token in enumerate(sorted(both)):
                at = [np.array([x]) for x in (len(a), a.index(token), len(b), b.index(token))]
                assert jaccard_join.may_reach(*at, 80, n)[0]


def test_near_copies_of_one_document(spark):
    """Hundreds of copies with ever more changes: long lists, stars, and members that
    no star reaches."""
    rng = random.Random(6)
    base = [f"w{j}" for j in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(150)] = f"n{rng.randrange(400)}"
        rows.append((i, " ".join(words).encode()))
    table = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(4)
    found = collected(jaccard_join.similar_components(table))
    want = plain_components(rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == want
    assert len({c for _, _, c in want}) > 5
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in collected(jaccard_join.similar_components(table, rounds=0))) == want


def plain_pieces(text, library):
    ids = [*library.encode(text, add_special_tokens=False).ids, 2]
    out, at = [], 0
    while at < len(ids):
        n = min(4096, 1 << int(math.log2(len(ids) - at)))
        out.append((at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
        at += n
    return out


def test_pipeline_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = Tokenizer.from_file(P.path(packing.VOCABULARY))
    rows = {r.doc_id: r for r in docs.collect()}
    vocabularies = plain_vocabularies()
    rows = {i: r.text for i, r in rows.items() if plain_figures(r.text, r.lang, *vocabularies)[2]}
    least = {int(c) for _, _, c in plain_components([(i, t.encode()) for i, t in rows.items()])}
    rows = {i: t for i, t in rows.items() if i in least}
    left = {int(i): kept.decode("utf-8", "ignore") for i, _, _, _, kept in plain_dedup([(i, t.encode()) for i, t in rows.items()])}
    want = Counter((i, *piece) for i, t in left.items() if t for piece in plain_pieces(t, library))
    stages = [s for _, s in corpus_pipeline.STAGES]
    for i, stage in enumerate(stages):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect()) == want


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, "").count() == 0
        assert stage(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.STAGES[3][1](spark, docs, "").count() == 0


def test_buckets_hold_equal_lengths(clashing, tmp_path):
    packing.write_buckets(packing.pack(clashing, limit=64), str(tmp_path / "b"))
    back = clashing.sparkSession.read.parquet(str(tmp_path / "b"))
    assert {(r.bucket, r.length) for r in back.collect()} == {(b, 1 << b) for b in range(7)}


def test_words_that_change_in_normal_form_are_packed_apart():
    tokenizer = packing.WordTokenizer(P.path(packing.VOCABULARY))
    library = Tokenizer.from_file(P.path(packing.VOCABULARY))
    words = ["Straße", "İx", "éa", "a b", "ΑΣ", "ﬁn", "'s", "don't!", "日本", "a1b22", "<|endoftext|>", "ǅ"]
    for some in (words, words[:1] + words[4:5], words[6:10]):
        want = [np.array(library.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in some]
        assert tokenizer.together([w.encode() for w in some]) == want


def test_lists_beyond_one_cascade(spark):
    """Sixty thousand listed keys in one cascade, and in several of few bits."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.k"), (F.col("id") * 7).cast("string"), F.lit(".example.com/x")).alias("url"))
    pages = pages.union(spark.createDataFrame([(-1, None), (-2, "nothing")], "page_id long, url string"))
    listed = spark.range(60_000).where("id % 3 = 0").select(F.concat(F.lit("k"), "id", F.lit(".example.com")).alias("key"))
    want = {i: 7 * i % 3 == 0 for i in range(3000)} | {-1: False, -2: False}
    for bits in (1 << 26, 1 << 16):
        found = {r.page_id: r.listed for r in url_filter.filter_urls(pages, listed, max_bits=bits).collect()}
        assert found == want
