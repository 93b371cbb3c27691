"""What a plan must not write, sample or gather, whatever the size."""

import random

import pytest
from test_engine import found, graph, reached

from edgeloom import measure, scratch
from edgeloom.llm import pii
from edgeloom.operators import compose, flow
from edgeloom.plans.pattern import Pattern


def test_pairs_of_a_cross_join_stay_in_their_tasks(spark, monkeypatch):
    """Chains joined as they come, whose first two share nothing: nothing is shuffled between the joins, and rows are those of the tree."""
    plans, save = [], scratch.save

    def saved(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return save(df, name)

    monkeypatch.setattr(scratch, "save", saved)
    rnd = random.Random(3)
    p = Pattern.from_graph(list("abcd"), [(0, 1, "x"), (2, 3, "y"), (1, 2, "z")], use_regex=False)
    for order in ([], [(0, 1)], [(1, 2), (2, 0)]):
        q, rows = p, []
        for a, b in order:
            q = q.before(a, b)
        for _ in range(120):
            k = rnd.randrange(3)
            a, b = ("ab", "cd", "bc")[k]
            rows.append((rnd.randrange(-20, 20), 10 * "abcd".index(a) + rnd.randrange(4), 10 * "abcd".index(b) + rnd.randrange(4), f"{'xyz'[k]}#{a}#{b}"))
        assert found(spark, rows, q, 5, left_deep=True) == found(spark, rows, q, 5) != []
    [plan] = [text for name, text in plans if name == "matches"][:1]
    between = plan.split("ShuffledHashJoin")
    assert len(between) == 3 and "Exchange" not in between[0] + between[1]
    assert spark.conf.get(compose.CO_PARTITION) == "true"


def test_partial_matches_count_once(spark):
    """A pair in one cell is met in two, and counted in the one it starts in; what goes with no third chain's row is not paired."""
    p = Pattern.from_graph(list("abcd"), [(0, 1, "x"), (2, 3, "y"), (1, 2, "z")], use_regex=False)
    rows = [(1, 0, 10, "x#a#b"), (2, 20, 30, "y#c#d"), (3, 10, 20, "z#b#c"), (12, 0, 10, "x#a#b"), (2, 0, 11, "x#a#b")]
    assert measure.states(graph(spark, rows), p, 5, left_deep=True) == [((0, 1), 1), ((0, 1, 2), 1)]


@pytest.mark.parametrize("known", [1_000_000, 25, 1])
def test_sources_are_put_off(monkeypatch, known):
    """Rows of random arcs, whatever a pass may know at once, against all walks; no pass knows much more than its bound and an instant."""
    monkeypatch.setattr(flow, "KNOWN", known)
    rnd, passes, one = random.Random(9), [], flow._pass
    monkeypatch.setattr(flow, "_pass", lambda *args: passes.append(1) or one(*args))
    for _ in range(60):
        arcs = sorted((rnd.randrange(30), rnd.randrange(8), rnd.randrange(8)) for _ in range(40))
        arcs = [(t, a, b, True, True) for t, a, b in arcs if a != b]
        got = [(s, b, d, t) for t, b, sources, departs in flow.updates(lambda: iter(arcs), 9) for s, d in zip(sources, departs, strict=True)]
        assert len(got) == len(set(got)) and set(got) == reached([(a, b, t) for t, a, b, _, _ in arcs], 9)
    assert (len(passes) > 60) == (known < 100)


def test_cells_of_many_pairs_need_no_rounds(spark, monkeypatch):
    """1500 arcs of some 1100 sources and as many targets in a cell: no joins of what is reached; and the same by rounds."""
    rnd = random.Random(4)
    g = graph(spark, [(rnd.randrange(100), *((u, k) if rnd.random() < 0.5 else (k, u)), "x#n#n") for u, k in ((rnd.randrange(100, 2600), rnd.randrange(9)) for _ in range(1500))])
    rounds, one = [], flow._fixpoint
    monkeypatch.setattr(flow, "_fixpoint", lambda *args: rounds.append(1) or one(*args))
    rows = lambda: sorted(tuple(r) for r in flow.reach(g, 100).select("src", "dst", "depart", "arrive").collect())
    plain = rows()
    assert not rounds
    monkeypatch.setattr(flow, "HEAVY", 1000), monkeypatch.setattr(flow, "KNOWN", 500), monkeypatch.setattr(flow, "BATCH", 100)
    assert rows() == plain and not rounds
    monkeypatch.setattr(flow, "ARCS", 0)
    assert rows() == plain and rounds


def test_pii_learns_from_every_document(spark, monkeypatch):
    """The examples of all texts are counted, those of rows without an id and of long texts, too."""
    texts = [f"n{i} a{i}.b@mail.example.com and 1.2.{i}" for i in range(300)] + ["x" * (1 << 20) + " 10.0.0.1", None, ""]
    docs = spark.createDataFrame([(None if i % 7 == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pii.vectors(docs).collect()
    assert sum(r.n for r in rows) == sum(len(pii.examples(t, 0)) for t in texts if t) > 900
    monkeypatch.setattr(pii, "TREES", 3)
    model = pii.train(docs)
    assert len(model.trees) == 3 and "email" in model.thresholds
