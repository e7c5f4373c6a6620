"""Line dedup and fill-in-middle against plain versions, on odd and hot tables."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import fill_in_middle, line_dedup
from quillgraph.llm.common import cut
from quillgraph.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_fill_in_middle"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{DATA}/documents.parquet'")
    found, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    assert sorted(map(tuple, found.select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def plain_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain_lines(rows, min_docs, min_chars=1):
    seen = Counter(k for _, t in rows for k in {plain_key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(plain_key(x)) >= min_chars and seen[plain_key(x)] >= min_docs)]
        out.append((str(i), len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


def odd_rows():
    rng = random.Random(4)
    lines = ["", " ", "a", "A ", "\tÉa", "éa", "ÉA", "日本", "x\x0b", "İ", "common line", " Common LINE\r", "ab ", "ab"] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "a\nown"), (None, "a\nown"), (103, "same\nA"), (103, "same\nA"), (103, "same\nA"), (104, "one\n" * 3000 + "end")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    names = ["own_id", "own_1", "own_2", "s", "h1", "h2", "pos", "batch", "lines", "hits", "gone", "n", "form", "output", "n_lines"]
    return spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names}).repartition(3).persist()


def judged(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in df.collect())


@pytest.mark.parametrize(("min_docs", "min_chars", "more"), [(10, 1, {}), (3, 1, {"batches": 5, "fan": 2, "heavy": 5}), (2, 3, {"batches": 1}), (1, 1, {"heavy": 1}), (3, 0, {})])
def test_lines_against_a_plain_version(docs, min_docs, min_chars, more):
    assert judged(line_dedup.line_dedup(docs, min_docs, min_chars, **more)) == plain_lines(odd_rows(), min_docs, min_chars)


def test_lines_of_nothing(docs):
    assert line_dedup.line_dedup(docs.where("false")).count() == 0
    assert fill_in_middle.fill_in_middle(docs.where("false")).count() == 0


def test_a_line_in_most_documents(spark):
    """A third of all lines is one line, and another third one document's."""
    rows = [(i, f"hot\nown {i}\nshared {i // 12}") for i in range(600)] + [(1000, "\n".join(["again"] * 900)), (1001, "Again ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert judged(line_dedup.line_dedup(docs, heavy=20)) == plain_lines(rows, 10)


def test_runs_in_levels(spark):
    """Batches that come one after another: counts are exact after each, levels hold fewer
    than ``fan`` runs, and a common line is in no later batch's run."""
    rng = random.Random(2)
    runs, seen = line_dedup.LineRuns(spark, min_docs=5, fan=3, buckets=3), Counter()
    for step in range(10):
        batch = Counter(rng.choice([rng.randint(0, 9), rng.randint(0, 400)]) for _ in range(60))
        runs.add(spark.createDataFrame([(k, -k, n, n) for k, n in batch.items()], "h1 long, h2 long, docs long, lines long"))
        seen.update(batch)
        assert {(r.h1, r.h2) for r in runs.all_common().collect()} == {(k, -k) for k, n in seen.items() if n >= 5}
        assert all(len(level) < 3 for level in runs.counted)
        known = {r.h1 for n in runs.common for r in spark.table(n).collect()}
        if (step + 1) % 3 and runs.common:
            assert not known & {r.h1 for r in spark.table(runs.counted[0][-1]).collect()}
    assert len(runs.counted) == 3 and len(runs.common) < 3


def test_runs_are_not_shuffled(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, buckets=4)
    rows = spark.range(1000).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).alias("docs"), F.lit(1).alias("lines"))
    names = [runs.write(rows) for _ in range(3)]
    assert {tuple(r) for r in runs.merged(names).collect()} == {(i, i, 3, 3) for i in range(1000)}
    anti = cut(rows).join(spark.table(names[0]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert anti.count("Exchange hashpartitioning") == 1


def plain_middle(doc_id, text, marks=("<P>", "<S>", "<M>")):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, (p, s, m) = len(text), marks
    if not text or any(x in text for x in marks) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


def test_middles_against_a_plain_version(spark, docs):
    rng = random.Random(9)
    letters = "ab<PSM>é日🙂\n\x00́ "
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 63, 64, 65, 128, 4095, 4096, 4097, 9000])))) for i in range(150)]
    rows += [(200, None), (None, "null id"), (201, "has <M> in it"), (202, "é🙂" * 40_000), (203, "x" * 65_536), (203, "x" * 65_536)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("own")).repartition(3)
    made = fill_in_middle.fill_in_middle(table)
    found = made.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found) == Counter((i, *plain_middle(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.again) for r in found) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_offsets_are_those_of_single_matches():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    rng = random.Random(3)
    ruler, single = fill_in_middle.Ruler((16, 4, 1)), Split(Regex("[\\s\\S]"), "isolated")
    for size in [*range(40), 64, 127, 128, 129, 300]:
        text = "".join(rng.choice("aé日🙂\n\ŕ") for _ in range(size))
        plain, coarse = [span for _, span in single.pre_tokenize_str(text)], ruler.coarse(text)
        assert ruler.count(coarse) == len(plain) == size
        assert [ruler.offset(coarse, k) for k in range(size + 1)] == [start for start, _ in plain] + [size]


def test_very_long_texts(spark):
    """A hundred thousand lines, half of them common, in some documents; one line of a megabyte."""
    shared = "\n".join(f"shared {i}\nown {{0}} {i}" for i in range(50_000))
    rows = [(i, shared.format(i) if i < 3 else "\n".join(f"shared {j}" for j in range(50_000))) for i in range(10)] + [(10, "é" * 500_000), (11, "\n" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()
    found = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert all((found[i].n_lines, found[i].n_dropped) == (100_000, 50_000) and found[i].text == "\n".join(f"own {i} {j}" for j in range(50_000)) for i in range(3))
    assert all((found[i].n_lines, found[i].n_dropped, found[i].text) == (50_000, 50_000, "") for i in range(3, 10))
    assert found[10].text == rows[10][1] and (found[11].n_lines, found[11].n_dropped) == (200_001, 0)
    made = fill_in_middle.fill_in_middle(docs)
    again = made.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert {r.doc_id: (r.n, r.again) for r in again} == {i: (len(t), t) for i, t in rows}
