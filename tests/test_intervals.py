"""Interval labels beside walks over the same edges."""

import random

import pytest

from corvane.operators import intervals


def ancestors_of(edges):
    """All ancestors of every type, by walking; none is its own."""
    up = {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    found = {}
    for c in {x for e in edges for x in e if x is not None}:
        seen, now = set(), {c}
        while now:
            now = {p for x in now for p in up.get(x, ())} - seen
            seen |= now
        found[c] = seen - {c}
    return found


def made(spark, edges, kind="string", types=()):
    inherits = spark.createDataFrame(edges, f"child_id {kind}, parent_id {kind}")
    own = spark.createDataFrame([(x,) for x in types], f"type_id {kind}")
    labels, extra = intervals.label(inherits, own)
    return labels, extra, intervals.intervals(labels, extra)


def random_edges(draw, n, more, cyclic=False):
    edges = [(i, draw.randrange(max(0, i - 6), i)) for i in range(1, n) if i % 11]
    edges += [(c, p) for c, p in ((draw.randrange(n), draw.randrange(n)) for _ in range(more)) if cyclic or p < c]
    return [(f"t{c:03}", f"t{p:03}") for c, p in edges]


@pytest.mark.parametrize("seed, more, cyclic", [(1, 0, False), (3, 25, False), (4, 12, True)])
def test_labels_equal_walks(spark, seed, more, cyclic):
    draw = random.Random(seed)
    edges = random_edges(draw, 70, more, cyclic)
    edges += [edges[0], (None, "t001"), ("t002", None), ("t003", "t003")]
    labels, extra, outer = made(spark, edges, types=["alone"])
    up = ancestors_of(edges) | {"alone": set()}
    down = {a: {c for c in up if a in up[c]} for a in up}
    rows = {r.type_id: r for r in labels.collect()}
    assert set(rows) == set(up) and sorted(r.pre for r in rows.values()) == list(range(len(up)))
    parent = {r.type_id: r.parent_id for r in rows.values()}
    for x, r in rows.items():
        chain, at = [], x
        while at is not None:
            chain.append(at)
            at = parent[at]
        assert r.depth == len(chain) - 1
        assert {y for y in rows if rows[y].pre <= r.pre <= rows[y].last} == set(chain)

    direct = {a: {c for c, p in edges if p == a and c not in (None, a)} for a in up}
    got = {r.ancestor_id: (r.n_total, r.n_direct) for r in intervals.subclass_counts(labels, extra, outer).collect()}
    assert got == {a: (len(down[a]), len(direct[a])) for a in up if down[a]}

    for root in ("t000", "t005", "alone", "nothing"):
        assert {r.type_id for r in intervals.below(labels, outer, root).collect()} == down.get(root, set())

    hits = draw.sample(sorted(up), 3) + ["elsewhere"]
    got = sorted(r.type_id for r in intervals.filter_tree(labels, extra, outer, spark.createDataFrame([(h,) for h in hits * 2], "type_id string")).collect())
    assert got == sorted(set(hits) | {a for h in hits for a in up.get(h, ())})

    refs = [(draw.choice([*sorted(up), "elsewhere"]), draw.choice("abcdefgh") if draw.random() < 0.7 else "hot") for _ in range(150)] + [(None, "a"), ("t001", None)]
    want = {}
    for s, a in refs:
        if s is not None and a is not None:
            for t in {s} | up.get(s, set()):
                want.setdefault(t, set()).add(a)
    got = {r.symbol_id: r.n_assets for r in intervals.usage_with_derived(spark.createDataFrame(refs, "symbol_id string, asset_path string"), labels, outer).collect()}
    assert got == {t: len(a) for t, a in want.items()}


def test_a_deep_chain_and_a_wide_parent(spark):
    n = 1000
    edges = [(i, i - 1) for i in range(1, n)] + [(n + i, 0) for i in range(n)]
    labels, extra, outer = made(spark, edges, "long")
    assert extra.isEmpty() and outer.isEmpty()
    rows = {r.type_id: r for r in labels.collect()}
    assert rows[0].pre == 0 and rows[0].last == 2 * n - 1 and rows[n - 1].depth == n - 1
    got = {r.ancestor_id: r.n_total for r in intervals.subclass_counts(labels, extra, outer).collect()}
    assert got == {0: 2 * n - 1} | {i: n - 1 - i for i in range(1, n - 1)}


def test_no_types(spark):
    labels, extra, outer = made(spark, [])
    assert labels.isEmpty() and extra.isEmpty() and outer.isEmpty()
    assert intervals.subclass_counts(labels, extra, outer).isEmpty()
    refs = spark.createDataFrame([("a", "x"), ("a", "y")], "symbol_id string, asset_path string")
    assert [tuple(r) for r in intervals.usage_with_derived(refs, labels, outer).collect()] == [("a", 2)]


def test_a_class_is_the_parent_before_an_interface(spark):
    edges = [("b", "a_interface", True), ("b", "z_class", False), ("c", "b", None)]
    labels, extra = intervals.label(spark.createDataFrame(edges, "child_id string, parent_id string, is_interface boolean"))
    assert {r.type_id: r.parent_id for r in labels.collect()} == {"b": "z_class", "c": "b", "a_interface": None, "z_class": None}
    assert [tuple(r) for r in extra.collect()] == [("b", "a_interface")]
