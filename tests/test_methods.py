"""Methods against plain versions: session-wide undo, conditional odds, continuous Sholl profiles, opening, skeleton graphs, wide images."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from somatica.operators import distance, morphology, pixels, qa, regions, sholl, skeleton, statistics, thresholds, vessels


def session(masks, events):
    state, stack = dict.fromkeys(masks), []
    for _, cell, area, op in events:
        if op == "undo":
            for m in stack.pop() if stack else ():
                state[m] = None
        elif (cell, area) in state:
            yes = op == "approve"
            more = [m for m in masks if m[0] == cell and m[1] != area and state[m] is None and (m[1] < area if yes else m[1] > area)]
            for m in ((cell, area), *more):
                state[m] = yes
            stack.append([(cell, area), *more])
    return state


@pytest.mark.parametrize("undos", [1, 4, 7])
@pytest.mark.parametrize("block", [4096, 16])
def test_session_undo(spark, monkeypatch, undos, block):
    rng = random.Random(undos)
    masks = [(c, a) for c in range(6) for a in range(200, 801, 100)]
    events = [(3 * k + 1, rng.randrange(6), rng.choice([200, 300, 500, 800, 900]), rng.choices(["approve", "reject", "undo"], [3, 3, undos])[0]) for k in range(400)]
    pairs = qa.undone
    monkeypatch.setattr(qa, "undone", lambda e: pairs(e, block))
    got = qa.replay_session(spark.createDataFrame(masks, "cell int, area int"), spark.createDataFrame(events, "seq long, cell int, area int, op string"))
    assert {(r.cell, r.area): r.approved for r in got.collect()} == session(masks, events)


def test_session_of_nothing(spark):
    masks = spark.createDataFrame([(1, 200), (1, 300)], "cell int, area int")
    events = spark.createDataFrame([(1, None, None, "undo")], "seq long, cell int, area int, op string")
    assert {r.approved for r in qa.replay_session(masks, events).collect()} == {None}
    assert qa.replay_session(masks.where("false"), events).count() == 0


def test_conditional_odds(spark):
    """Fisher's tea tasting and the twins of convicts, tables at their margins' ends, and a large table."""
    rows = [(3, 1, 4, 4), (2, 10, 17, 13), (0, 3, 5, 5), (5, 1, 5, 5), (500_000, 400_000, 1_000_000, 1_200_000)]
    got = [r.odds_ratio for r in statistics.conditional_odds(spark.createDataFrame(rows, "a long, b long, ra long, rb long")).orderBy("a").collect()]
    assert got[0] == 0 and got[1] == pytest.approx(0.0469366, rel=1e-5) and got[2] == pytest.approx(6.408309, rel=1e-5) and got[3] == math.inf
    assert got[4] == pytest.approx(2.0, rel=1e-4)


@pytest.mark.parametrize("seed", range(4))
def test_continuous_profile(spark, seed):
    """Arcs on circles walked in small steps."""
    rng = np.random.default_rng(seed)
    on = {(int(y), int(x)) for y, x in np.argwhere(rng.random((15, 17)) < [0.2, 0.5, 0.8, 1.0][seed])}
    mask = spark.createDataFrame([("a", *p) for p in on], "image string, y int, x int")
    rows = [tuple(r)[1:] for r in sholl.continuous(mask, spark.createDataFrame([("a", 7, 8, 1.3)], "image string, cy int, cx int, r0 double")).orderBy("from_radius").collect()]
    assert rows[0][0] >= 1.3 and all(a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False)) and rows[0][2] and rows[-1][2]
    for a, b, n in rows:
        t = np.arange(20_000) / 20_000 * 2 * math.pi
        r = (a + b) / 2
        inside = [p in on for p in zip(np.floor(7.5 + r * np.sin(t)).astype(int).tolist(), np.floor(8.5 + r * np.cos(t)).astype(int).tolist(), strict=True)]
        assert n == (sum(x and not y for x, y in zip(inside, inside[-1:] + inside[:-1], strict=True)) or int(inside[0]))


def test_rays(spark):
    """Four arms: four arcs on every circle; a ring: one, where the circle lies in it."""
    arms = [("arms", 20 + s * k, 20) for s in (-1, 1) for k in range(1, 15)] + [("arms", 20, 20 + s * k) for s in (-1, 1) for k in range(1, 15)]
    ring = [("ring", y, x) for y in range(41) for x in range(41) if 8 <= math.hypot(y - 20, x - 20) <= 12]
    mask = spark.createDataFrame(arms + ring, "image string, y int, x int")
    centres = spark.createDataFrame([(i, 20, 20, 3.0) for i in ("arms", "ring")], "image string, cy int, cx int, r0 double")
    got = sholl.continuous(mask, centres).collect()
    assert {r.n for r in got if r.image == "arms" and r.to_radius < 14} == {4}
    assert {r.n for r in got if r.image == "ring" and r.from_radius <= 10 <= r.to_radius} == {1}
    soma = sholl.soma_centres(spark.createDataFrame([("a", y, x) for y in (4, 5, 6) for x in (1, 2, 3, 4)], "image string, y int, x int")).first()
    assert (soma.cy, soma.cx) == (5, 3) and soma.r0 == pytest.approx(math.sqrt(12 / math.pi))


def test_opening_by_radius(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(y), int(x)) for k in range(6) for y, x in np.argwhere(rng.random((30, 30)) < 0.93)]
    mask = spark.createDataFrame(rows, "image int, y int, x int")
    got = {tuple(r) for r in distance.opened(mask, 1 + F.col("image") % 3).collect()}
    want = {tuple(r) for k in range(3) for r in morphology.open_(mask.where(F.col("image") % 3 == k), morphology.disk(k + 1)).collect()}
    assert got == want and {r[0] for r in got} >= {0, 1, 3, 4}


def test_longest_path_on_graphs(spark):
    """Against distances relaxed over all pixels."""
    rng = np.random.default_rng(2)
    masks = {}
    for k in range(40):
        m = rng.random(rng.integers(2, 13, 2)) < rng.choice([0.2, 0.35, 0.5])
        if k % 8 == 0:
            m[:] = False
            m[0, :] = m[-1, :] = m[:, 0] = m[:, -1] = True
        if m.any():
            masks[k] = [(int(y), int(x)) for y, x in np.argwhere(m)]
    d = spark.createDataFrame([(k, y, x) for k, ps in masks.items() for y, x in ps], "image int, y int, x int")
    got = {r.image: r.longest_shortest_path for r in skeleton.longest_path(d).collect()}
    for k, ps in masks.items():
        own, todo = {min(ps)}, [min(ps)]
        near = lambda p: [q for q in ((p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j) if q in set(ps)]  # noqa: B023, E731
        while todo:
            todo += [q for q in near(todo.pop()) if q not in own and not own.add(q)]
        ends = [p for p in own if len(near(p)) != 2]
        best = 0.0
        for e in ends:
            far = {e: 0.0}
            changed = True
            while changed:
                changed = False
                for p in list(far):
                    for q in near(p):
                        w = far[p] + math.dist(p, q)
                        if w < far.get(q, math.inf) - 1e-12:
                            far[q], changed = w, True
            best = max([best, *(far[q] for q in ends)])
        assert got[k] == pytest.approx(best)


def test_wide_images(spark):
    """Nothing is lost or joined beyond column 65,535."""
    mask = spark.createDataFrame([("a", 0, 65_536), ("a", 1, 0), ("a", 0, 65_535), ("a", 5, 70_000), ("a", 6, 70_001)], "image string, y int, x int")
    assert morphology.components(mask).count() == 5 and morphology.components(mask).select("label").distinct().count() == 3
    ends = spark.createDataFrame([("a", 0, 0), ("a", 0, 100_000)], "image string, y int, x int")
    assert regions.spread_from_centroid(ends, 1.0).first()[1] == 50_000
    line = spark.createDataFrame([("a", 0, x) for x in range(65_530, 65_545)], "image string, y int, x int")
    assert skeleton.longest_path(line).first().longest_shortest_path == 14


def test_display_colour(spark):
    px = spark.createDataFrame([("a", c, 0, x, float(v)) for c, vs in ((0, (0, 100)), (1, (50, 50)), (2, (10, 20))) for x, v in enumerate(vs)], "image string, c int, y int, x int, v double")
    got = {(r.c, r.x): r.v for r in pixels.display_colour(px, 0.0, 0.0, {0: 20.0}).collect()}
    assert got == {(0, 0): 30, (0, 1): 255, (1, 0): 50, (1, 1): 50, (2, 0): 0, (2, 1): 255}


def test_vessels_by_ridges(spark):
    """A line stays, a broad blob does not; a black image has no vessels."""
    a = np.zeros((60, 60))
    a[30, 5:55] = 100
    rows = [("line", int(y), int(x), float(a[y, x])) for y, x in np.ndindex(a.shape)] + [("black", 0, 0, 0.0)]
    px = spark.createDataFrame(rows, "image string, y int, x int, v double")
    found = vessels.vessel_mask(px, 60, 60, 1.0, tubes=True, sigmas=(1.0, 2.0))
    got = {(r.y, r.x) for r in found.collect()}
    assert {(30, x) for x in range(8, 52)} <= got and all(abs(y - 30) <= 4 for y, _ in got) and found.where("image = 'black'").count() == 0
    cells = spark.createDataFrame([("line", 1, 30, x) for x in range(10, 20)], "image string, cell int, y int, x int")
    e = vessels.exposure(cells, px, found, cells.where("x = 10"), 1.0, px.withColumn("v", F.col("v") * 3)).first()
    assert e.cd31_exposure_mean == 300 and e.dist_to_vessel_um == 0 and e.vessel_contact_fraction == 1


def test_percentiles(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.integers(0, 65_536, 999), "b": rng.integers(0, 3, 10), "c": np.array([7])}
    px = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "image string, v double")
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in thresholds.percentiles(px, shares).collect():
        v = np.sort(values[r.image])
        assert [r[n] for n in shares] == [int(v[max(1, math.ceil(round(q * len(v), 6))) - 1]) for q in shares.values()]
    assert thresholds.percentiles(px.where("false"), shares).count() == 0


def test_polynomial_fits(spark):
    """Against numpy's fits, and the tail of F by summing its density."""
    rng = np.random.default_rng(3)
    profiles, rows = {}, []
    for k, n in enumerate((25, 40, 5, 3, 2, 12)):
        y = np.maximum(0, np.round(8 * np.exp(-(((np.arange(n) - n / 3) / (n / 5)) ** 2)) + rng.normal(0, 1, n))) if k < 5 else np.full(n, 3.0)
        profiles[k] = (2.0 + np.arange(n), y)
        rows += [(k, float(a), int(b)) for a, b in zip(*profiles[k], strict=True)]
    d = spark.createDataFrame(rows, "image int, radius double, n long")
    got = {(r.image, r.degree): (r.r2, r.p) for r in sholl.fit_quality(d, 12).collect()}
    assert {k for k, _ in got} == {0, 1, 2, 3, 5} and max(g for k, g in got if k == 2) == 3
    for (k, g), (r2, p) in got.items():
        r, y = profiles[k]
        spread = ((y - y.mean()) ** 2).sum()
        want = 1 - ((y - np.polynomial.Polynomial.fit(r, y, g)(r)) ** 2).sum() / spread if spread else 0.0
        assert r2 == pytest.approx(want, abs=1e-8)
        a, b = (len(r) - g - 1) / 2, g / 2
        t = (np.arange(200_001) + 0.5) / 200_001 * (1 - r2)
        density = (t ** (a - 1) * (1 - t) ** (b - 1)).sum() * (1 - r2) / 200_001 / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
        assert p == pytest.approx(min(density, 1.0), abs=3e-3)
    best = {r.image: r for r in sholl.best_polynomial(d).collect()}
    assert set(best) == set(profiles) and best[4].degree is None and best[5].degree is None
    for k in (0, 1):
        fits = [g for g in range(1, 13) if got[k, g][0] >= 0.7 and got[k, g][1] <= 0.05]
        curve = np.polynomial.Polynomial.fit(*profiles[k], fits[0])
        fine = np.linspace(profiles[k][0][0], profiles[k][0][-1], 1001)
        assert best[k].degree == fits[0] and best[k].critical_value == pytest.approx(curve(fine).max()) and best[k].critical_radius == pytest.approx(fine[curve(fine).argmax()])
    # a fit that explains enough, on too few radii to mean anything, does not count
    few = spark.createDataFrame([(1, float(i), int(n)) for i, n in enumerate((1, 2, 2, 4))], "image int, radius double, n long")
    assert sholl.fit_quality(few).where("r2 >= 0.7 and p > 0.05").count() > 0 and sholl.best_polynomial(few).first().degree is None
