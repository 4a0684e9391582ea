"""Density clusters against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import ann, density


def plain_near(x, k):
    """(id, other, distance, rank) of the k nearest others, from the whole matrix."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 9)
    np.fill_diagonal(score, -np.inf)
    rows = []
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), -score[i]))[:k]
        rows += [(i, int(j), float(np.sqrt(max(2 - 2 * score[i, j], 0.0))), r) for r, j in enumerate(order, 1)]
    return rows


def plain_clusters(n, near, least, cuts):
    """Components of all links up to each cut, from scratch; leaves of their tree."""
    core = {}
    for i, _, d, r in near:
        if r <= least:
            core[i] = max(core.get(i, 0.0), d)
    links = {(min(i, j), max(i, j)): max(d, core[i], core[j]) for i, j, d, _ in near}
    leaves, levels = {}, []
    for cut in cuts:
        group = list(range(n))

        def find(x, group=group):
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        for (i, j), w in links.items():
            if w <= cut:
                group[max(find(i), find(j))] = min(find(i), find(j))
        members = {}
        for i in range(n):
            members.setdefault(find(i), set()).add(i)
        levels.append([m for m in members.values() if len(m) >= least])
    live = []  # clusters that have met no other: their points
    done = []
    ended = []
    for large in levels:
        following = []
        for m in large:
            inside, over = [c for c in live if c & m], any(c & m for c in ended)
            if over or len(inside) > 1:
                done += inside
                ended = [c for c in ended if not c & m] + [m]
            else:
                following.append(m)
        live = following
    if len(live) + len(ended) > 1:
        done += live
    leaves = {i: min(c) for c in done for i in c}
    return {frozenset(c) for c in done}, leaves


@pytest.fixture(scope="module")
def blobs(spark, tmp_path_factory):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(9, 12))
    x = np.concatenate([c + (0.15 + 0.05 * k) * rnd.normal(size=(180, 12)) for k, c in enumerate(centres)] + [rnd.normal(size=(380, 12))])
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(5000, None)], "id long, embedding array<double>").repartition(4)
    index = ann.create(rows, str(tmp_path_factory.mktemp("blobs") / "index"))
    return x, index


def test_clusters_are_those_of_the_whole_matrix(spark, blobs, monkeypatch):
    x, index = blobs
    near = density.ann.neighbours(index, 20, probes=len(index.centroids))
    rows = {(r.id, r.other, round(r.distance, 6), r["rank"]) for r in near.collect()}
    wanted = plain_near(x, 20)
    assert rows == {(i, j, round(d, 6), r) for i, j, d, r in wanted} and len(rows) == 2000 * 20
    least, links = 20, density.mutual_links(near, 20).cache()
    cuts = density.cut_distances(links, 24)
    found = {r.id: r.cluster for r in density.leaf_clusters(index.vectors.select("id"), links, least, cuts).collect()}
    groups = {}
    for i, c in found.items():
        if c is not None:
            groups.setdefault(c, set()).add(i)
    clusters, _ = plain_clusters(len(x), wanted, least, [c + 1e-9 for c in cuts])
    assert {frozenset(g) for g in groups.values()} == clusters and len(clusters) >= 6 and found[5000] is None
    assert all(c in g for c, g in groups.items())
    monkeypatch.setattr(density, "DRIVER_LINKS", 0)  # all by joins
    few = {r.id: r.cluster for r in density.leaf_clusters(index.vectors.select("id"), links, least, cuts[::6] + cuts[-1:]).collect()}
    monkeypatch.undo()
    again = {r.id: r.cluster for r in density.leaf_clusters(index.vectors.select("id"), links, least, cuts[::6] + cuts[-1:]).collect()}
    assert few == again


def test_calibrated_lists_find_the_same_groups(blobs):
    x, index = blobs
    found = {r.id: r.cluster for r in density.density_clusters(index).collect()}
    sizes = {}
    for k in range(5):  # the dense ones
        own = [found[i] for i in range(180 * k, 180 * (k + 1)) if found[i] != density.NOISE]
        sizes[k] = max((own.count(c) for c in set(own)), default=0)
    assert len(found) == 2001 and found[5000] == density.NOISE and sum(s >= 120 for s in sizes.values()) >= 4


def test_few_points_are_noise(spark, tmp_path):
    rows = spark.createDataFrame([(k, [1.0, k / 10]) for k in range(4)], "id long, embedding array<double>")
    assert {r.cluster for r in density.density_clusters(ann.create(rows, f"{tmp_path}/few")).collect()} == {-1}
    none = rows.limit(0)
    assert density.density_clusters(ann.create(none, f"{tmp_path}/none")).count() == 0
    links = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.1), (4, 5, 0.2), (5, 6, 0.2)], "a long, b long, w double")
    ids = spark.range(1, 8)
    got = {r.id: r.cluster for r in density.leaf_clusters(ids, links, 3, density.cut_distances(links)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: None}
    assert {r.cluster for r in density.leaf_clusters(ids.where("id < 4"), links.where("w < 0.2"), 3, [0.1]).collect()} == {None}


def kept(coords, near, k=15):
    """Share of the k nearest others that are among the k nearest on the map."""
    d = ((coords[:, None] - coords[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    found = np.argsort(d, axis=1)[:, :k]
    true = {}
    for i, j, _, r in near:
        if r <= k:
            true.setdefault(i, set()).add(j)
    return np.mean([len(true[i] & set(found[i])) / k for i in range(len(coords))])


def test_map_keeps_neighbours_better_than_principal_components(blobs):
    from textloom.operators import layout

    x, index = blobs
    near = density.written(ann.neighbours(index, 15), "near")
    place = lambda df: np.array([[r.x, r.y] for r in sorted(df.collect(), key=lambda r: r.id) if r.id < 5000])
    drawn = layout.layout(index, near)
    true = plain_near(x, 15)
    flat = kept(place(layout.principal_components(index.vectors, "id", "embedding")), true)
    found = {r.id: (r.x, r.y) for r in drawn.collect()}
    ours = kept(place(drawn), true)
    print("kept", flat, ours)
    assert len(found) == 2001 and found[5000] == (0.0, 0.0) and ours > 1.3 * flat


def test_neighbours_cost_rows_by_vectors_not_by_tasks(blobs, monkeypatch):
    """Also in pieces smaller than a list, with copies, and with vectors that ask for some lists only."""
    x, index = blobs
    spark, ranked, given = index.vectors.sparkSession, ann.vector.ranked_lists, []
    monkeypatch.setattr(ann.vector, "ranked_lists", lambda rows, *more: given.append(rows.count()) or ranked(rows, *more))
    rows = {(r.id, r.other, round(r.distance, 6), r["rank"]) for r in ann.neighbours(index, 20, len(index.centroids)).collect()}
    wanted = {(i, j, round(d, 6), r) for i, j, d, r in plain_near(x, 20)}
    assert rows == wanted and given == [2000 * 20]  # a row for each task's best before
    monkeypatch.setattr(ann, "PIECE", 12 * 150)
    monkeypatch.setattr(ann, "ASKING", 100)
    monkeypatch.setattr(ann, "COMPARED", 64)
    assert rows == {(r.id, r.other, round(r.distance, 6), r["rank"]) for r in ann.neighbours(index, 20, len(index.centroids)).collect()}
    few = {(r.id, r.other): round(r.distance, 6) for r in ann.neighbours(index, 5, 2).collect()}
    listed = {r.id: r.list for r in index.vectors.where("list >= 0").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-(unit @ index.centroids.T), axis=1, kind="stable")[:, :2]
    of = np.array([listed[i] for i in range(len(x))])
    d = np.sqrt(np.maximum(2 - 2 * np.round(unit @ unit.T, 9), 0))
    np.fill_diagonal(d, np.inf)
    for i in range(0, len(x), 50):
        there = [j for j in np.argsort(d[i], kind="stable") if of[j] in order[i] and j != i][:5]
        assert {j for a, j in few if a == i} == set(there), i
    copies = spark.createDataFrame([(i, [1.0, 2.0] if i % 2 else [2.0, -1.0]) for i in range(200)], "id long, embedding array<double>")
    same = {(r.id, r.other) for r in ann.neighbours(ann.create(copies, density.shared_folder(spark, "copies")), 3, 9).collect()}
    assert same == {(i, j) for i in range(200) for j in [j for j in range(i % 2, 8, 2) if j != i][:3]}


def test_a_length_is_taken_once_for_a_vector(spark):
    from textloom.operators import vector

    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([-2.0],)], "v array<float>")
    assert [r[0] for r in rows.select(vector.unit(rows.v)).collect()] == [[0.6, 0.8], None, None, [-1.0]]
    plan = rows.select(vector.unit(rows.v))._jdf.queryExecution().analyzed().toString().lower()
    assert "/ sqrt(aggregate(" not in plan  # for each number before
