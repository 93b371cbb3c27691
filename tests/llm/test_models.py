"""Classifiers: held-out accuracy, and the cases that no data covers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.llm import ann, language, pii, quality

SF = "/root/testdata/sf0.01"
EDGE = [(None, None, None, 1.5), (1, "", "en", 2.5), (1, "", "en", 2.5), (2, "12 !?", None, None), (3, "wort " * 60000, "de", 1.0), (4, "Übung macht", "de", 1.0), (5, "the word and the other", "en", None)]
SCHEMA = "doc_id long, text string, lang string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language(spark, docs):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    edge = spark.createDataFrame(EDGE, SCHEMA)
    rows = language.identify(edge).collect()
    assert len(rows) == len(EDGE) and {r.lang_pred for r in rows if r.doc_id in (1, 2, None)} == {"und"}
    assert language.identify(edge.limit(0)).count() == 0
    assert language.identify(edge.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_numbers_are_no_letters(spark):
    """Fractions, Roman numerals and digits of any script aren't, marks and modified letters go as Unicode has them."""
    for text in ("½ ² ③ Ⅷ", "١٢٣ 四 _ 9" if not "四".isalpha() else "١٢٣ _ 9", "\u0301"):
        assert language.letters(text) == b""
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(chr(rnd.choice((rnd.randrange(32, 127), rnd.randrange(160, 600), rnd.randrange(0x2000, 0x2500), rnd.randrange(0x4E00, 0x4E20)))) for _ in range(40))
        assert language.letters(text) == " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode()
    some = spark.createDataFrame([*((i, "the word and the other", "en") for i in range(9)), (14, "½ ² ③", None), (15, "the wörd", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.identify(some).collect()} == {**dict.fromkeys([*range(9), 15], "en"), 14: "und"}


def test_language_by_plain_compression(spark, docs):
    """The sizes are what compressing each piece anew with each language's own texts gives."""
    import zstandard

    dicts = language.dictionaries(docs)
    by = language.Compressors(dicts)

    def size(lang, raw):
        d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return sum(len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False).compress(raw[k : k + language.PIECE])) for k in range(0, len(raw), language.PIECE))

    for r in docs.orderBy("doc_id").limit(60).collect():
        if raw := language.letters(r.text):
            sizes = {lang: size(lang, raw) for lang in dicts}
            assert sizes[by.predict(r.text)[0]] == min(sizes.values())
    learnt = {letters for d in dicts.values() for letters in d.split(b"\n")}
    assert all(len(d) <= language.SIZE for d in dicts.values()) and learnt
    with pytest.raises(ValueError):
        language.dictionaries(spark.range(0, 3000, 3).selectExpr("id as doc_id", "'a b' as text", "cast(id as string) as lang"))


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    edge = spark.createDataFrame(EDGE, SCHEMA)
    some = spark.createDataFrame([(1, 0, "x"), (2, 1, None), (2, 0, "y"), (3, None, "z"), (None, 1, "z"), (4, 7, "z"), (5, 1, "t")], "doc_id long, quality int, text string")
    rows = quality.classify(edge, some).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert {r.score for r in quality.classify(edge, some.limit(0)).collect()} == {1.0}
    assert quality.classify(edge.limit(0), some).count() == 0
    assert quality.without_rejected(edge, some).columns == edge.columns


def test_quality_learns_from_all_passages(spark, monkeypatch):
    """Bags of long texts are whole; the bound on passages takes whole documents; of several texts of a document one counts."""
    bags = []
    monkeypatch.setattr(quality, "fit", lambda b, y: bags.append(b))
    texts = {i: "some plain words. " * 30 * i for i in range(1, 240)}
    docs = spark.createDataFrame([*texts.items(), *[(7, f"other {k}") for k in range(40)]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    every = {len(quality.bag(t.encode())) for t in texts.values()}
    quality.train(docs, labels)
    assert max(map(len, bags[0])) > 200 and {len(b) for b in bags[0]} <= every and 150 < len(bags[0]) < len(texts)
    quality.train(docs, labels, most_passages=5000)
    assert {len(b) for b in bags[1]} <= every and 4000 < sum(map(len, bags[1])) <= 5000


def test_quality_gradient():
    """Of every layer, against finite differences."""
    rnd = np.random.RandomState(0)
    sizes = np.array([1, 3, 2, 5])
    x, y, w = rnd.normal(size=(sizes.sum(), 4)), np.array([0.0, 1, 1, 0]), quality.start(4)
    _, grad = quality.gradient(w, x, sizes, y)
    for name, p in w.items():
        for at in np.ndindex(p.shape):
            side = []
            for d in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in w.items()}
                moved[name][at] += d
                side.append(quality.gradient(moved, x, sizes, y)[0])
            assert abs((side[0] - side[1]) / 2e-5 - grad[name][at]) < 1e-7, (name, at)
    bags = np.split(x, np.cumsum(sizes)[:-1])
    m = quality.fit(bags * 20, np.tile(y, 20), epochs=200, size=16)
    assert quality.gradient(m.layers, (np.concatenate(bags) - m.mean) / m.scale, sizes, y)[0] < 0.1


def test_quality_scores_by_hand():
    """Passage after passage, in plain loops, and in blocks of any size."""
    import math

    rnd = random.Random(1)
    texts = ["", "One short text.", " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(900)), "x" * 5000 + "\nlines\n" * 200]
    bags = [quality.bag(t.encode()) for t in texts]
    model = quality.fit([b for b in bags for _ in range(8)], np.array([0.0, 1, 1, 0]).repeat(8), epochs=3)
    w = model.layers
    for t, b in zip(texts, bags, strict=True):
        hidden, logits = [], []
        for row in (b - model.mean) / model.scale:
            h = [math.tanh(sum(float(row[i]) * w["e"][i, j] for i in range(len(row))) + w["eb"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[i] * w["v"][i, j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * w["u"][i, j] for i in range(len(h))))) for j in range(quality.GATE)]
            hidden.append(h), logits.append(sum(g * float(v) for g, v in zip(gate, w["w"], strict=True)))
        share = [math.exp(v) for v in logits]
        z = [sum(s * h[j] for s, h in zip(share, hidden, strict=True)) / sum(share) for j in range(quality.HIDDEN)]
        want = 1 / (1 + math.exp(-sum(a * float(o) for a, o in zip(z, w["o"], strict=True)) - float(w["ob"][0])))
        for block in (1, 3, 512):
            quality.BLOCK, old = block, quality.BLOCK
            try:
                assert abs(model.score(t.encode()) - want) < 1e-5
            finally:
                quality.BLOCK = old


def test_quality_passages_stand_alone():
    """What a passage is described by is in it alone."""
    a, b = b"plain words and so on. " * 23, b"####\n" * 110
    whole = quality.bag((a[:512] + b[:512]))
    assert np.array_equal(whole[0], quality.bag(a[:512])[0]) and np.array_equal(whole[1], quality.bag(b[:512])[0])


def test_strict_spans():
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(text):
        out = []
        for k, p in patterns.items():
            for m in re.finditer(p, text):
                n = len(re.sub("[^0-9]", "", m[0]))
                ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= n <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0])), "phone": 9 <= n <= 15}[k]
                if ok:
                    out.append((k, m.start(), m.end()))
        return out

    rnd = random.Random(2)
    for _ in range(20000):
        text = "".join(rnd.choice(["1", "25", "4242424242424242", ".", "@", "a.b", "-", " ", "+1", "(", "x", "9" * 9, "0001", "é", "@@"]) for _ in range(rnd.randrange(1, 14)))
        assert pii.strict(text) == plain(text), text
    assert pii.strict("a" * 300000 + "@" + "1" * 300000)[:1] == []


def test_pii(spark, docs):
    rows = pii.find(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in rows:
        base, every = pii.strict(texts[r.doc_id]), [s for s in r.spans.split(",") if s]
        assert [sum(b[0] == k for b in base) for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert {f"{k}:{a}:{z}" for k, a, z in base} <= set(every)
    edge = spark.createDataFrame(EDGE, SCHEMA)
    assert pii.find(edge).where("spans = ''").count() == len(EDGE) and pii.find(edge.limit(0)).count() == 0
    assert pii.redacted("mail a@b.c now", [("email", 5, 10)]) == "mail [email] now"


def test_pii_of_very_long_texts():
    """Spans of a text as long as a book take about as long for each byte as those of a page."""
    import time

    model = pii.Model(start=2.0, thresholds=dict.fromkeys(pii.KINDS, 0.5))
    page = " ".join(f"Call 0{i % 900 + 100}-555-{i % 9000 + 1000} or mail a{i}.b@x{i}.example.com, {i % 250}.{i % 200}.7.{i % 90} at 4242 4242 4242 42{i % 90 + 10}." for i in range(9000))
    began = time.process_time()
    base, every = pii.spans(page, model)
    assert len(page) > 700_000 and len(base) >= 18_000 and len(every) > len(base) and time.process_time() - began < 60
    for kind in pii.KINDS:
        own = [(a, z) for k, a, z in every if k == kind]
        assert all(z <= a for (_, z), (a, _) in zip(own, own[1:]))


def test_spans_against_all_pairs():
    rnd = random.Random(5)
    for _ in range(300):
        s, plain = pii.Spans(), []
        for _ in range(30):
            a = rnd.randrange(100)
            z = a + rnd.randrange(1, 12)
            assert s.overlaps(a, z) == any(a < y and b < z for b, y in plain)
            assert s.within(a, z) == next(((b, y) for b, y in sorted(plain) if a <= b and y <= z), None)
            if not s.overlaps(a, z):
                s.add(a, z), plain.append((a, z))


def test_pii_on_planted_spans(spark):
    """What the trees that documents teach add: spelt-out forms that no strict pattern has, and few of what only looks alike."""
    rnd, model = random.Random(11), pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    planted = {
        "email": lambda: f"write to {rnd.choice('abc')}{rnd.randrange(100)}.doe{rnd.choice((' at ', ' [at] ', '(at)'))}mail{rnd.randrange(9)}.example.com",
        "ip": lambda: "host " + rnd.choice(("[.]", " dot ", "(dot)")).join(str(rnd.randrange(1, 255)) for _ in range(4)),
        "phone": lambda: f"call {rnd.randrange(200, 999)}-{rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)}",
    }
    caught = {}
    for kind, make in planted.items():
        texts = [f"Some words before, {make()}, and after." for _ in range(200)]
        caught[kind] = sum(any(k == kind for k, _, _ in pii.spans(t, model)[1]) for t in texts) / len(texts)
    plain = [f"In {rnd.randrange(1900, 2030)}, version {rnd.randrange(9)}.{rnd.randrange(9)}.{rnd.randrange(9)} had {rnd.randrange(10**6)} users and met at home, page {rnd.randrange(300)}." for _ in range(400)]
    wrong = sum(bool(pii.spans(t, model)[1]) for t in plain) / len(plain)
    print("caught", caught, "wrong", wrong, "thresholds", model.thresholds)
    assert caught["email"] > 0.8 and caught["ip"] > 0.5 and wrong < 0.05


def test_pii_adds_spans():
    rnd, x, y, held = random.Random(1), [], [], []
    for i in range(600):
        phone, ip = f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}", ".".join(str(rnd.randrange(256)) for _ in range(4))
        for e, t in pii.examples(f"Words {phone} and {ip} or a{i}.b@mail.example.com or {rnd.randrange(10**8)}-{rnd.randrange(10**5)} v{i}.2.3 there.", i):
            x.append(e), y.append(t), held.append(i % 3 == 0)
    m = pii.fit(np.array(x), np.array(y), np.array(held))
    text = "Call (319) 555-5132 or write to joe.doe at mail.example.com today"
    assert pii.strict(text) == [] and {k for k, _, _ in pii.spans(text, m)[1]} == {"phone", "email"}


def test_pii_of_a_rare_kind(spark):
    """Most documents hold other numbers, a few in a hundred a card: that kind has its threshold."""
    rnd, rows = random.Random(6), []
    for i in range(3000):
        number = f"{rnd.randrange(10**5, 10**6)}-{rnd.randrange(10**5, 10**6)}"
        if i % 25 == 0:
            number = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
            number = next(number + d for d in "0123456789" if pii.luhn(number + d))
        rows.append((i, f"Paid on {rnd.randrange(10, 28)}.{rnd.randrange(1, 12)}.2019 by {number} here"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(docs, most=200)
    assert "card" in model.thresholds
    drawn = pii._drawn(docs, 200, 60)
    card = pii.KINDS.index("card")
    n = sum(i % 25 == 0 for i in drawn)
    assert n == 60 and {drawn[i][card] for i in drawn if i % 25 == 0} == {2.0}
    assert abs(sum(w[card] for i, w in drawn.items()) - 3000) < 1e-6


def _found(table, **how):
    got = {}
    for r in ann.nearest(table, **how).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def _recall(got, ids, v):
    right = 0
    for q, hits in got.items():
        s = ann.cosine(np.repeat(v[ids == q][:1], len(v), 0), v)
        want = sorted(((-x, i) for x, i in zip(s, ids) if i != q))[:5]
        assert [r for r, _, _ in sorted(hits)] == [1, 2, 3, 4, 5]
        right += len({i for _, i in want} & {i for _, i, _ in hits})
    return right / (5 * len(got))


def test_nearest(spark, monkeypatch):
    rnd = np.random.RandomState(4)
    base = rnd.normal(size=(400, 16))
    rows = [(i, [float(v) for v in base[i % 300]], "e") for i in range(1, 1200)]
    rows += [(50_000, None, "n"), (50_050, [0.0] * 16, "z"), (50_100, [float("nan")] * 16, "n"), (50_150, [None] * 16, "n"), (None, [1.0] * 16, "i"), (50_200, [1.0], "d"), (50, [float(v) for v in base[50]], "again")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    good = sorted({(i, tuple(v)) for i, v, _ in rows[:1199] + rows[-1:]})
    ids, v = np.array([i for i, _ in good]), np.array([v for _, v in good])
    got = _found(table)
    assert sorted(got) == [i for i in ids if i % 50 == 0] and _recall(got, ids, v) >= 0.9
    assert ann.nearest(table.limit(0)).count() == 0
    few = ann.nearest(table.where("vec_id in (50, 51, 52)")).collect()
    assert {(r.query_id, r.vec_id) for r in few} == {(50, 51), (50, 52)}
    monkeypatch.setattr(ann, "PART", 40), monkeypatch.setattr(ann, "ASKING", 3)  # lists in many parts
    assert {q: sorted(h) for q, h in _found(table).items()} == {q: sorted(h) for q, h in got.items()}


def test_nearest_needs_its_codes(spark, monkeypatch):
    """Of 6000 vectors; with codebooks that say nothing, most neighbours are lost."""
    rnd = np.random.RandomState(7)
    v = (rnd.normal(size=(40, 32))[rnd.randint(0, 40, 6000)] + 0.7 * rnd.normal(size=(6000, 32))).astype(np.float32)
    table = spark.createDataFrame([(i + 1, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    ids = np.arange(1, 6001)
    monkeypatch.setattr(ann, "RERANK", 64)
    assert _recall(_found(table, each=100), ids, v) >= 0.9
    monkeypatch.setattr(ann, "fit", lambda x: rnd.normal(size=(ann.BOOKS, ann.WORDS, x.shape[1])).astype(np.float32))
    assert _recall(_found(table, each=100), ids, v) < 0.6


def test_nearest_of_large_doubles(spark):
    """Doubles beyond floats take part, and count as they are."""
    rows = [(50, [1e200, 1.0]), (51, [1e100, 1e-9]), (52, [1.0, 1.0 + 1e-12]), (53, [1.0, 1.0]), (100, [1.0, 1.0 + 2e-12])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got if r.query_id == 100} == {50, 51, 52, 53}


def test_ids_beyond_doubles_beside_null(spark):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "the word", "en"), (None, "some text", "en"), (big + 2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(big, 1)], "doc_id long, quality int")
    for out in (language.identify(docs), quality.classify(docs, labels), pii.find(docs)):
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted([str(big), str(big + 2), "None"])
