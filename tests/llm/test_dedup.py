import random

import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from edgeloom.llm import near_dedup as nd
from edgeloom.llm.components import components
from edgeloom.llm.exact_dedup import exact_dedup, without_copies

SCHEMA = "doc_id long, text string, digest string, keep_id int"
EDGE = [
    (4, "a  b", "x", 1), (3, "a b", "x", 1), (9, "a\n\tb", None, 2), (5, " a b", "y", 3), (1, None, "", 4), (2, "", "", 5),
    (7, "long " * 30000, "", 6), (8, "long  " * 30000, "", 6), (3, "a b", "x", 1), (None, "a b", "n", 0), (None, "only null", "n", 0),
]


@pytest.mark.parametrize("bits", [256, 4])
def test_exact_dedup(spark, bits):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(EDGE, SCHEMA), digest_bits=bits).collect()}
    assert got == {
        (4, 3, 5, False), (3, 3, 5, True), (9, 3, 5, False), (None, 3, 5, False), (5, 5, 1, True), (1, 1, 2, True), (2, 1, 2, False),
        (7, 7, 2, True), (8, 7, 2, False), (None, None, 1, True),
    }


def test_exact_dedup_of_nothing_and_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(none).count() == 0 and nd.near_dedup(none).count() == 0
    kept = without_copies(spark.createDataFrame(EDGE, SCHEMA))
    assert kept.columns == ["doc_id", "text", "digest", "keep_id"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "5", "7", "None", "None"]


def brute(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup_against_all_pairs(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("the of and to in is that for it as was with be by on not he his but at are".split()) + rnd.choice("abcdefgh")
    rows = []
    for base in range(25):
        text = [word() for _ in range(rnd.choice([2, 5, 30, 80, 300]))]
        for _ in range(rnd.choice([1, 2, 6])):
            t = list(text)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                t[rnd.randrange(len(t))] = word()
            rows.append((len(rows) * 3, rnd.choice([" ", "\n", "\t "]).join(t)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "Äh"), (504, "äh"), (505, "ONE two"), (506, "one TWO")]
    for words, num in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), words, num, 100).collect()}
        assert got == brute(rows, words, num, 100)


def test_near_dedup_across_a_cell(spark):
    """A chain whose ends aren't alike, and rows with null or repeated ids."""
    w = [f"w{i}" for i in range(200)]
    chain = [(i, " ".join(w[4 * i : 4 * i + 100])) for i in range(20)] + [(3, "w1 w2 w3 w4 w5 w6"), (None, "w1 w2 w3 w4 w5 w6"), (None, "x y z u v w")]
    got = nd.near_dedup(spark.createDataFrame(chain, "doc_id long, text string"), 3, 85, 100).collect()
    assert {r.component_id for r in got if r.doc_id is not None and r.n_shingles > 90} == {0}
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["0", "None"]


def _blocked(n):
    """Texts alike enough to share first sketches, most of them, in families of nearly equal ones."""
    rnd = random.Random(n)
    base, families, out = [f"b{i}" for i in range(120)], [], []
    for f in range(n // 8):
        families.append([w if k not in (10, 35, 60, 85)[: f % 5] else f"f{f}y{k}" for k, w in enumerate(base)])
    for i in range(n):
        w = list(rnd.choice(families))
        for k in rnd.sample(range(120), i % 3):
            w[k] = f"x{i}y{k}"
        out.append((i, " ".join(w)))
    return out


def test_near_dedup_in_blocks(spark, monkeypatch):
    """Several blocks, slices of few shingles, and tables that are shuffled instead of broadcast give what all pairs give."""
    rows = _blocked(160)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85, 100)
    assert 1 < len({c for _, c in want.values()}) < 160
    for block, shingles, slices, ids in ((256, 1 << 19, 1 << 17, 400_000), (16, 1 << 19, 500, 400_000), (64, 900, 1 << 17, 0)):
        for name, value in (("BLOCK", block), ("BLOCK_SHINGLES", shingles), ("SHINGLES", slices), ("BROADCAST_IDS", ids)):
            monkeypatch.setattr(nd, name, value)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(docs, 3, 85, 100).collect()}
        assert got == want


def test_intersections_in_slices():
    import numpy as np

    rnd = np.random.RandomState(3)
    sets = [np.unique(rnd.randint(0, 2**63, 300).astype(np.uint64) * np.uint64(2) if i % 2 else np.arange(i, i + 200, dtype=np.uint64) << np.uint64(55)) for i in range(12)]
    sets[3] = np.union1d(sets[1], sets[2])
    x, y = np.array([0, 1, 3, 5]), np.array([1, 2, 3, 4, 11])
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in y] for i in x]
    for most in (50, 1000, 1 << 17):
        assert nd.common(sets, x, y, most).tolist() == want


def test_hot_keys(spark):
    """A key of most rows is dealt out by salts, rows without a partner stay where the join is a left one."""
    from pyspark.sql import functions as F

    from edgeloom.llm.rows import join_hot

    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("key"))
    right = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("key % 2 <> 0").withColumn("says", F.col("key") * 2)
    for how in ("inner", "left"):
        got = sorted((r.id, r.says) for r in join_hot(left, right, "key", "n", F.col("id"), how).collect())
        assert got == sorted((r.id, r.says) for r in left.join(right, "key", how).collect())
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "a b c d e f"), (None, "a b c d e f"), (big + 2, "")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in nd.near_dedup(docs).collect()) == sorted([str(big), str(big + 2), "None"])


def test_near_dedup_pairs_of_few_equal_sketches(spark):
    """Pairs of similarity 8 / 10 that share a sketch of each collection, but only 4 or 5 of 24."""
    rows = []
    for n in (29705, 65823, 140338, 147533):
        w = [f"s{n}w{i}" for i in range(10)]
        rows += [(2 * n, " ".join(w[:9])), (2 * n + 1, " ".join(w[:8] + w[9:]))]
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i, _ in rows}


def test_copies_without_ids_of_their_own(spark):
    """Rows with a null or a repeated doc_id are left out where they are copies, and only there."""
    copies = lambda *rows: spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    seen = lambda df: sorted((str(r.doc_id), " ".join(r.text.split())) for r in df.collect())
    got = corpus_pipeline.exact_copies(spark, spark.createDataFrame(EDGE, SCHEMA), "")
    assert got.columns == ["doc_id", "text", "digest", "keep_id"] and sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "5", "7", "None"]
    rows = copies((9, "x"), (9, "y"), (2, "y"), (9, "y"), (None, "z"), (None, "z"), (None, "x"), (4, "v"))
    assert seen(corpus_pipeline.exact_copies(spark, rows, "")) == [("2", "y"), ("4", "v"), ("9", "x"), ("None", "z")]
    w = [f"w{i}" for i in range(100)]
    full, near, other = " ".join(w), " ".join(w[:99] + ["end"]), " ".join(f"v{i}" for i in range(60))
    rows = copies((None, full), (None, near), (None, other), (5, full), (5, near), (None, other), (5, "a b c d e f"), (5, "a b c d e f"), (7, "g h i j k l"))
    got = [("5", "first" if t in (full, near) else t) for i, t in seen(corpus_pipeline.near_copies(spark, rows, "")) if i == "5"]
    assert got == [("5", "a b c d e f"), ("5", "first")]
    assert [x for x in seen(corpus_pipeline.near_copies(spark, rows, "")) if x[0] != "5"] == [("7", "g h i j k l"), ("None", other)]


def test_pipeline_on_edge_cases(spark, tmp_path):
    """The stages in sequence: clean texts stay, copies go, every row that is left has its ids; and tables with nothing in them."""
    rnd = random.Random(8)
    words = "the of and to in is that for it as was with be by on not he his but at are we you they have one".split()
    prose = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "."]) for _ in range(n)).capitalize() + "."
    junk = lambda: "".join(rnd.choice("#%&$@!~^*0123456789") for _ in range(400))
    rows, marks = [], []
    for i in range(120):
        good = i % 4 != 0
        rows.append((i, prose(60) if good else junk(), "en", "web" if i % 3 else "books", 9))
        marks.append((i, int(good), 0))
    first = rows[1][1]
    rows += [(500, first, "en", "web", 1), (501, first.replace(" ", "  "), "en", "web", 1), (502, first + " more", "en", "web", 1), (None, first, None, None, None), (None, prose(50), None, None, None), (7, rows[7][1], "en", "web", 9), (503, prose(40000), "en", "web", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, table in (("full", rows), ("none", [])):
        spark.createDataFrame(table, schema).withColumn("copies", F.lit("x")).withColumn("name", F.lit(1)).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    got = {r.doc_id for r in out}
    assert not any(i is not None and i < 120 and i % 4 == 0 for i in got) and not got & {500, 501, 502}
    assert {i for i in range(120) if i % 4} <= got and 503 in got and sum(r.doc_id is None for r in out) in (1, 2) and all(len(r.ids) == r.n_tokens for r in out)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}
