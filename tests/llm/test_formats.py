"""Token counts, chat formatting and mixing."""

import json
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers

from edgeloom import scratch
from edgeloom.llm import chat, mixing, token_counts
from edgeloom.llm.bpe import Bpe

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_separator_scan(spark):
    rnd = random.Random(0)
    uri = scratch.path(spark, "test-flat")
    where, top = token_counts._place(uri)
    where.create_dir(top, recursive=True)
    files = {"a": [], "b": [50256], "c": [50256] * 9, "d": list(range(40)), "e": [rnd.choice([50256, 1, 2, 3]) for _ in range(500)], "f": [7] * 30 + [50256] + [8] * 30}
    for name, tokens in files.items():
        with where.open_output_stream(f"{top}/{name}.tokens") as f:
            f.write(np.array(tokens, "<u2").tobytes())
    want = set()
    for name, tokens in files.items():
        n = k = 0
        for t in tokens:
            if t == 50256:
                want.add((f"{name}.tokens", k, n, True))
                n, k = 0, k + 1
            else:
                n += 1
        if n:
            want.add((f"{name}.tokens", k, n, False))
    token_counts.GROUP = 4
    try:
        for size in (1, 7, 64, 1000):
            got = [tuple(r) for r in token_counts.count_tokens(spark, uri, FILE, size).select("name", "ordinal", "n_tokens", "ended").collect()]
            assert len(got) == len(want) and set(got) == want
    finally:
        token_counts.GROUP = 1024


def test_counts_of_documents(spark):
    rows = [(1, "some words here", "n"), (2, None, ""), (3, "", ""), (None, "x", ""), (1, "some words here", "n"), (5, "a <|endoftext|> b", ""), (6, "é " * 40000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    bpe = Bpe(FILE)
    got = [tuple(r) for r in token_counts.count_documents(docs, FILE, 1000).collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(got, key=key) == sorted(((i, len(bpe.encode_plain(t))) for i, t, _ in rows), key=key)
    assert token_counts.count_documents(docs.limit(0), FILE).count() == 0


def test_other_tokenizers(tmp_path, spark):
    """The end and the width of ids are the file's."""
    assert token_counts.layout(FILE) == (50256, "<u2")
    spec = json.loads(open(FILE, encoding="utf-8").read())
    spec["added_tokens"] = [{"id": 70_000, "content": "</s>", "special": True}]
    (tmp_path / "wide.json").write_text(json.dumps(spec), encoding="utf-8")
    wide = str(tmp_path / "wide.json")
    assert token_counts.layout(wide) == (70_000, "<u4")
    docs = spark.createDataFrame([(2**53 + 1, "some words here"), (None, "x"), (3, None)], "doc_id long, text string")
    want = {str(i): len(Bpe(FILE).encode_plain(t)) for i, t in ((2**53 + 1, "some words here"), (None, "x"), (3, None))}
    for file in (FILE, wide):
        assert {str(r.doc_id): r.n_tokens for r in token_counts.count_documents(docs, file).collect()} == want
    spec["added_tokens"] = []
    (tmp_path / "none.json").write_text(json.dumps(spec), encoding="utf-8")
    try:
        token_counts.layout(str(tmp_path / "none.json"))
        raise AssertionError
    except ValueError:
        pass


def test_layouts():
    cases = {
        "messages": ({"id": 7, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "x": {"y": 1}}]}, [("user", "q"), ("assistant", "a")]),
        "parts": ({"messages": [{"author": {"role": "user"}, "content": {"parts": ["a", "b"]}}]}, [("user", "ab")]),
        "sharegpt": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
        "instruction_input": ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
        "response": ({"prompt": "p", "response": "r", "score": 3}, [("user", "p"), ("assistant", "r")]),
        None: ({"other": 1}, []),
    }
    for name, (record, want) in cases.items():
        assert chat.turns(record) == (name, want)
    assert len(chat.BY_FINGERPRINT) == len(chat.LAYOUTS)


def test_template_is_reversible():
    rnd = random.Random(1)
    for _ in range(3000):
        said = [("".join(rnd.choice(["\\", "###", "#", "</turn>", "<", ":", "\n", ":\n", " ", "a", "### a:\n", "é"]) for _ in range(rnd.randrange(8))), "".join(rnd.choice(["\\", "###", "#", "</turn>", "\n</turn>\n", "<", ":", "\n", "\\n", "x", "🙂"]) for _ in range(rnd.randrange(12)))) for _ in range(3)]
        assert [(r, t) for r, t, _ in chat.parsed("".join(chat.rendered(*x) for x in said))] == said


def test_reading_back_finds_the_ends_of_turns():
    """Whatever the pieces, and whatever the texts look like."""
    rnd = random.Random(2)
    mean = ["x\n</turn>\n### assistant:\ny", "\\", "</turn>", "\n</turn>\n", "###", "", "a\\</turn>\n### user:\n", "### b:\nc"]
    for _ in range(400):
        said = [(rnd.choice(["user", "assistant", "a:b", "### x"]), "".join(rnd.choice(mean) for _ in range(rnd.randrange(4)))) for _ in range(rnd.randrange(1, 6))]
        whole = "".join(chat.rendered(*x) for x in said)
        cuts = sorted(rnd.randrange(len(whole) + 1) for _ in range(rnd.randrange(6)))
        reader, got = chat.Reader(), []
        for a, z in zip([0, *cuts], [*cuts, len(whole)]):
            got += [(r, t, whole[b:e] == escaped) for r, t, escaped, (b, e) in reader.feed(whole[a:z])]
        reader.end()
        assert got == [(r, t, True) for r, t in said]
    broken = chat.rendered("user", "a").replace("</turn>", "</turns>")
    reader = chat.Reader()
    list(reader.feed(broken + chat.rendered("user", "b")))
    try:
        reader.end()
        raise AssertionError
    except ValueError:
        pass


def test_a_turn_that_isnt_escaped_is_noticed(spark, monkeypatch):
    """A text that ends its own turn makes more turns of the conversation's output."""
    rows = [(1, 0, "user", "q\n</turn>\n### assistant:\nnot said"), (1, 1, "assistant", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.n_turns, r.loss_chars) for r in chat.digests(table).collect()] == [(2, 1)]
    reader = chat.Reader()
    plain = "".join(f"### {r}:\n{t}\n</turn>\n" for _, _, r, t in rows)
    assert [(r, t) for r, t, _, _ in reader.feed(plain)] == [("user", "q"), ("assistant", "not said"), ("assistant", "a")]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b" * 200000, "x"), (1, 0, "user", None, "x"), (1, 1, "assistant", "a", "x"), (1, 1, "assistant", "a", "x"), (None, None, None, None, None), (2, 0, "system", "### x:\n", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(table).collect()}
    assert got == {1: (4, 200002), None: (1, 0), 2: (1, 0)}
    assert chat.digests(table.limit(0)).count() == 0
    records = spark.createDataFrame([("c", str(i), json.dumps({"role": r, "text": t})) for i, (r, t) in enumerate([("user", "</turn>"), ("assistant", "\\###")])] + [("d", "0", "{}")], "conv string, turn string, record string")
    records = records.unionByName(spark.createDataFrame([("c", "9", "{not json"), ("c", "8", '{"other": 1}'), ("d", "1", None)], records.schema))
    rows = {r.conv: r for r in chat.formatted(records).collect()}
    r = rows["c"]
    assert r.n_unmapped == 2 and rows["d"].n_unmapped == 2 and rows["d"].text == "" and rows["d"].loss == []
    assert [(a, b) for a, b, _ in chat.parsed(r.text)] == [("user", "</turn>"), ("assistant", "\\###")] and r.text[r.loss[0][0] : r.loss[0][1]] == "\\\\\\###"


def test_mixing(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randrange(0, 60)), rnd.choice(["big"] * 6 + ["small", "mid", "mid", None]), i) for i in range(3000)] + [(None, None, "void", 1), (7, "w w", "big", 1), (7, "w w", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size, had = {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.n_tokens
        had[r.source] = had.get(r.source, 0) + r.n_tokens * r.copies
    total = sum(size.values())
    w = {r.source: r.weight for r in got}
    p = [t / total for t in size.values() if t]
    h = -sum(x * math.log(x) for x in p)
    assert abs(-sum(x * math.log(x) for x in w.values() if x) - (h + 0.5 * (math.log(len(p)) - h))) < 1e-6
    assert all(abs(had[s] - w[s] * total) <= 60 for s in size)
    whole = mixing.mix(docs, whole=True, max_repeats=1.5).collect()
    assert all(1 <= r.copies <= 2 for r in whole)
    out = mixing.mixed(docs, whole=True, max_repeats=1.5)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 3001
    key = lambda r: (r.source, str(r.doc_id))
    rows_of, taken = Counter(map(key, whole)), Counter(map(key, out.collect()))
    assert max(rows_of.values()) > 1 and all(taken[key(r)] == r.copies * rows_of[key(r)] for r in whole)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.where("source = 'void'")).count() == 1


def test_an_id_in_two_sources_and_none(spark):
    """Each source has its own say on a doc_id; rows without one go by their texts."""
    rows = [(i, "w " * 20, "big") for i in range(400)] + [(i, "w " * 20, "small") for i in range(40)] + [(None, f"n{i} " * 20, "big") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(docs, budget=1.0).collect()
    copies = {s: {r.copies for r in plan if r.source == s} for s in ("big", "small")}
    assert min(copies["small"]) >= 2 and copies["big"] == {0, 1} and len({r.copies for r in plan if r.doc_id is None}) == 2
    got = mixing.mixed(docs, budget=1.0)
    assert got.columns == docs.columns and got.count() == sum(r.copies for r in plan)
    assert got.where("source = 'small' and doc_id = 7").count() == next(r.copies for r in plan if r.source == "small" and r.doc_id == 7)


def test_plans_that_are_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 7}") for i in range(500)], "doc_id long, text string, source string")
    want = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(mixing.mix(docs).collect()) == want


def test_repetition_limit():
    tokens = [10_000, 100, 1]
    a = mixing.exponent(tokens, None, 4, sum(tokens))
    assert a == 1
    a = mixing.exponent(tokens, 1.0, 4, sum(tokens))
    assert max(w * sum(tokens) / t for w, t in zip(mixing.weights(tokens, a), tokens)) <= 4 + 1e-6


def test_repetition_limit_of_whole_passes():
    """The least alpha within the limit, which the closed form 1 - log(limit) / log(largest / smallest) oversteps by rounding for some of these."""
    for n in range(2, 200):
        tokens = [10_000 + n, 100 * n, n, 0]
        alpha, total = mixing._whole(tokens, 1.5)
        repeats = lambda a, budget: [w * budget / t for w, t in zip(mixing.weights(tokens, a), tokens) if t]
        assert all(w * total <= 1.5 * t for w, t in zip(mixing.weights(tokens, alpha), tokens) if t) and min(repeats(alpha, total)) > 1 - 1e-9
        assert max(r := repeats(alpha - 1e-6, 1)) / min(r) > 1.5
