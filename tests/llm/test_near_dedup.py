import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from grainmill.llm import graph
from grainmill.llm import near_dedup as nd
from grainmill.llm.graph import components


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent=80):
    sets = [(d, shingles(t, width)) for d, t in rows]
    comp = {d: d for d, _ in rows if d is not None}
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    while True:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if before == comp:
            return comp


def rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "one two"), (6, "ONE\x0btwo")]
    base = list(rng.choice(words, 120))
    for i in range(150):  # one large group, of which some hang on by few
        w = list(base)
        for _ in range(int(rng.integers(0, 16))):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(words))
        out.append((100 + i, " ".join(w)))
    chain = list(rng.choice(words, 60))
    for i in range(12):  # a chain: neighbours alike, the ends not
        out.append((400 + i, " ".join(chain)))
        chain = chain[3:] + list(rng.choice(words, 3))
    out += [(500 + i, " ".join(rng.choice(words, 50))) for i in range(60)]
    out += [(600 + i, out[20][1]) for i in range(40)] + [(7, out[30][1] + " x"), (7, out[-1][1]), (None, base[0]), (None, out[20][1])]
    return out


@pytest.mark.parametrize(("width", "block"), [(2, 512), (5, 512), (2, 11)])
def test_same_as_brute_force(spark, monkeypatch, width, block):
    """With small blocks, a bucket's rows and probes lie in many of them."""
    monkeypatch.setattr(nd, "BLOCK", block)
    data = rows()
    df = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id long, text string, bucket int")
    got = nd.near_components(df, width=width).collect()
    want = brute(data, width)
    assert len(got) == len(data) and {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, width)) for _, t in data)
    kept = {r.doc_id for r in nd.drop_near_copies(df, width=width).collect()}
    assert kept == {d for d, c in want.items() if d == c} | {None}


def test_empty(spark):
    assert nd.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20), st.sampled_from([1, 100_000]))
def test_components(spark, edges, a_task):
    """Also where edges are too many for one task, and joins take the place of windows."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(graph, "EDGES_PER_TASK", a_task)
        same_components(spark, edges)


def same_components(spark, edges):
    comp = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in comp:
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == comp and len(got) == len(comp)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 3000, 900).astype(np.uint64)) for _ in range(2))
        assert np.bitwise_count(nd.parity(a) ^ nd.parity(b)).sum() <= len(np.setxor1d(a, b))
