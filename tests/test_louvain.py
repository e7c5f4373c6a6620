"""Louvain with folded leaves: planted communities against a plain version, stars, trees."""

import random
from collections import defaultdict

import pytest

from quillgraph.operators import graph


def plain_louvain(edges):
    """Blondel et al., one node after another, in order."""
    links = defaultdict(lambda: defaultdict(float))
    for x, y, w in edges:
        links[x][y] += w
        links[y][x] += w
    placed = {n: n for n in links}
    while True:
        total = sum(sum(v.values()) for v in links.values())
        k = {n: sum(v.values()) for n, v in links.items()}
        at, size = {n: n for n in links}, dict(k)
        moved = again = True
        moved = False
        while again:
            again = False
            for n in sorted(links):
                near = defaultdict(float)
                for m, w in links[n].items():
                    if m != n:
                        near[at[m]] += w
                size[at[n]] -= k[n]
                best = max([(near.get(at[n], 0.0) - k[n] * size[at[n]] / total, True, at[n])] + [(w - k[n] * size[c] / total, False, c) for c, w in near.items()], key=lambda g: (round(g[0], 9), g[1]))[2]
                size[best] += k[n]
                if best != at[n]:
                    at[n], again, moved = best, True, True
        if not moved:
            return placed
        placed = {n: at[c] for n, c in placed.items()}
        new = defaultdict(lambda: defaultdict(float))
        for n, v in links.items():
            for m, w in v.items():
                new[at[n]][at[m]] += w
        links = new


def plain_modularity(edges, placed):
    total, inside, k = 0.0, 0.0, defaultdict(float)
    for x, y, w in edges:
        total += 2 * w
        k[placed[x]] += w
        k[placed[y]] += w
        inside += 2 * w * (placed[x] == placed[y])
    return inside / total - sum(s * s for s in k.values()) / total**2


def planted(seed, groups=6, each=12, within=0.6, across=0.02, leaves=20):
    rng = random.Random(seed)
    n = groups * each
    edges = {(x, y) for x in range(n) for y in range(x + 1, n) if rng.random() < (within if x % groups == y % groups else across)}
    return [(x, y, 1.0) for x, y in sorted(edges)] + [(rng.randrange(n), n + i, 1.0) for i in range(leaves)]


def found(spark, edges):
    return {r.node: r.community for r in graph.louvain(spark.createDataFrame(edges, "x long, y long, w double")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_communities(spark, seed):
    edges = planted(seed)
    got = found(spark, edges)
    assert set(got) == {n for x, y, _ in edges for n in (x, y)}
    assert plain_modularity(edges, got) >= plain_modularity(edges, plain_louvain(edges)) - 1e-9
    for x, y, _ in edges[-20:]:
        assert got[x] == got[y]  # leaves are with their neighbours


def test_stars_pairs_and_paths(spark):
    edges = [(0, i, 1.0) for i in range(1, 40)] + [(100, 101, 2.0), (201, 200, 1.0), (300, 301, 1.0), (301, 302, 1.0), (302, 303, 1.0), (303, 304, 1.0), (304, 305, 1.0), (7, 7, 5.0)]
    got = found(spark, edges)
    assert {got[i] for i in range(40)} == {0}
    assert got[100] == got[101] == 100 and got[200] == got[201] == 200
    assert got[300] == got[301] and got[304] == got[305]
    assert plain_modularity(edges[:-1], got) >= plain_modularity(edges[:-1], plain_louvain(edges[:-1])) - 1e-9
    assert found(spark, [(1, 1, 3.0)]) == {}


def test_a_star_takes_no_turns(spark, monkeypatch):
    seen = []
    plain = graph.settle
    monkeypatch.setattr(graph, "settle", lambda g, *a: seen.append(g.where("x <> y").count()) or plain(g, *a))
    assert set(found(spark, [(i % 5 + 1000, i, 1.0) for i in range(300)]).values()) == set(range(5))
    assert seen == [0]
