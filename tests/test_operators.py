"""Operators against brute force on small frames, with ties, gaps, repeats and empty groups."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipoff.operators import aggregates as A
from tipoff.operators import history as H
from tipoff.operators import joins as J
from tipoff.operators import matching as X
from tipoff.operators import metrics as M
from tipoff.operators import ranking as R
from tipoff.operators import boosting as BO
from tipoff.operators.boosting import fit_boosted_trees
from tipoff.operators.linear import fit_ridge, fit_ridge_by_label
from tipoff.operators.logistic import fit_logistic
from tipoff.operators.peers import peer_statistics
from tipoff.operators.slots import slot_filling
from tipoff.session import pinned

HISTORY = [("a", 2001, "x", 1.0), ("a", 2001, "y", 3.0), ("a", 2002, "x", None), ("a", 2005, "y", 7.0), ("b", 2003, "x", 5.0)]


def frame(spark):
    return spark.createDataFrame(HISTORY, "e string, s int, t string, v double")


def test_prior_never_sees_its_own_season(spark):
    stats = [H.Stat("n", "rows"), H.Stat("m", "mean", F.col("v")), H.Stat("hi", "max", F.col("v"))]
    got = {(r["e"], r["s"]): r for r in H.prior_stats(frame(spark), ["e"], "s", stats).collect()}
    assert (got["a", 2001]["n"], got["a", 2001]["m"]) == (0, None)
    assert (got["a", 2002]["n"], got["a", 2002]["m"]) == (2, 2.0)
    assert (got["a", 2005]["n"], got["a", 2005]["m"], got["a", 2005]["hi"]) == (3, 2.0, 3.0)


def test_later_rows_change_nothing_earlier(spark):
    stats = [H.Stat("m", "mean", F.col("v"))]
    before = {(r["e"], r["s"]): r["m"] for r in H.prior_stats(frame(spark), ["e"], "s", stats).collect()}
    more = frame(spark).unionByName(spark.createDataFrame([("a", 2005, "z", 100.0)], "e string, s int, t string, v double"))
    after = {(r["e"], r["s"]): r["m"] for r in H.prior_stats(more, ["e"], "s", stats).collect()}
    assert before == after


def test_last_rows_skip_nulls_without_replacing(spark):
    got = H.prior_last_rows(frame(spark), ["e"], "s", ["t"], ["v"], 2).withColumn("m", H.tail_mean("last_rows", "v", 2))
    by = {(r["e"], r["s"]): r for r in got.collect()}
    assert by["a", 2005]["m"] == 3.0 and [x["t"] for x in by["a", 2005]["last_rows"]] == ["y", "x"]
    assert by["a", 2001]["m"] is None


def test_grid_covers_gaps(spark):
    grid = H.season_grid(frame(spark), ["e"], "s")
    got = {(r["e"], r["s"]): r["n"] for r in H.prior_stats(frame(spark), ["e"], "s", [H.Stat("n", "rows")], grid).collect()}
    assert got == {
        ("a", 2002): 2, ("a", 2003): 3, ("a", 2004): 3, ("a", 2005): 3, ("a", 2006): 4, ("b", 2004): 1, ("b", 2005): 1, ("b", 2006): 1
    }


def test_tenure_stops_at_gap_and_change(spark):
    rows = [("t", 2001, "k"), ("t", 2002, "k"), ("t", 2003, "k"), ("u", 2001, "k"), ("u", 2003, "k"), ("w", 2002, "j"), ("w", 2003, "k")]
    got = H.current_tenure(spark.createDataFrame(rows, "e string, s int, p string"), "e", "s", "p")
    assert {r["e"]: r["tenure"] for r in got.collect()} == {"t": 3, "u": 1, "w": 1}


def test_peers_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"g{i % 3}", rng.choice([None, 1.0, 2.0, 2.0, 3.5, 7.0])) for i in range(40)] + [(99, "solo", 4.0)]
    got = peer_statistics(spark.createDataFrame(rows, "id int, g string, v double"), ["g"], "v", "id", {"big": 3.0})
    for r in got.collect():
        peers = sorted(v for i, g, v in rows if g == r["g"] and i != r["id"] and v is not None)
        if not peers:
            assert r["peer_mean"] is None and r["peer_median"] is None and r["peer_best"] is None
            continue
        assert abs(r["peer_mean"] - np.mean(peers)) < 1e-9 and r["peer_median"] == np.median(peers)
        assert r["peer_best"] == peers[-1] and abs(r["peer_top3_mean"] - np.mean(peers[-3:])) < 1e-9
        assert abs(r["peer_big_share"] - np.mean([p >= 3 for p in peers])) < 1e-9


def test_ranks_and_medians_split_groups(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else "cold", float(rng.randint(0, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, v double")
    got = {r["id"]: (r["rank"], r["n"]) for r in R.ordinal_rank(df, ["g"], [F.col("v").desc(), F.col("id")], "rank", "n").collect()}
    for g in ("hot", "cold"):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in mine] == [(i + 1, len(mine)) for i in range(len(mine))]
    med = {r["g"]: r["v"] for r in R.medians(df, ["g"], ["v"]).collect()}
    fast = {r["g"]: r["v"] for r in R.medians(df, ["g"], ["v"], rows_bound=200).collect()}
    assert med == fast == {g: float(np.median([v for _, h, v in rows if h == g])) for g in ("hot", "cold")}


def test_percentile_of_single_row_is_zero(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", 1.0), (2, "c", 1.0), (2, "d", None)], "s int, k string, v double")
    got = {r["k"]: r["v_percentile"] for r in R.ordinal_percentiles(df, ["s"], ["k"], ["v"]).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 1.0, "d": None}


def test_greedy_dedupe_matches_sequential_pass(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice([None, *map(str, range(12))]), f"n{rng.randint(0, 12)}") for i in range(60)]
    ids, names, want = set(), set(), []
    for i, key, name in rows:
        if (key is not None and key in ids) or name in names:
            continue
        want.append(i)
        names.add(name)
        if key is not None:
            ids.add(key)
    df = spark.createDataFrame(rows, "i int, id string, name string")
    for block in (1_000_000, 20):
        got = J.first_rows_greedy(df, [["id"], ["name"]], "i", block)
        assert sorted(r["i"] for r in got.collect()) == want


def test_greedy_dedupe_of_a_long_chain(spark, monkeypatch):
    """A chain, in which each row shares a key with the next, needs few rounds; rows without any key all stay."""
    pins = []
    monkeypatch.setattr(J, "pinned", lambda df: pins.append(1) or pinned(df))
    n = 3000
    chain = spark.range(n).selectExpr("id as i", "cast(id div 2 as string) as id", "concat('n', (id + 1) div 2) as name")
    bare = spark.createDataFrame([(n, None, ""), (n + 1, "", None), (n + 2, None, None)], "i long, id string, name string")
    got = J.first_rows_greedy(chain.union(bare), [["id"], ["name"]], "i").select("i").collect()
    assert sorted(r["i"] for r in got) == [*range(0, n, 2), n, n + 1, n + 2]
    assert len(pins) <= 5
    assert J.first_rows_greedy(chain.limit(0), [["id"], ["name"]], "i").count() == 0


def test_best_match_equals_full_search(spark):
    rng = random.Random(2)
    words = ["state", "north", "carolina", "saint", "marys", "tech", "western", "ohio", "valley"]
    universe = sorted({" ".join(rng.sample(words, 2)) for _ in range(40)})
    asked = set()
    for name in universe[:25]:
        at = rng.randrange(len(name))
        asked.add(name[:at] + name[at + 1 :])
        asked.add(name[:at] + "z" + name[at:])
    asked |= {"qqq", "ohio", universe[3]}
    left = spark.createDataFrame([(a,) for a in sorted(asked)], "key string")
    right = spark.createDataFrame([(u,) for u in universe], "key string")
    got = {r["key"]: (r["other"], r["score"]) for r in X.best_matches(left, right, "key").collect()}
    for a in asked:
        best, top = None, 0.0
        for u in universe:
            score = 1.0 if a == u else SequenceMatcher(None, a, u).ratio()
            if score > top:
                best, top = u, score
        assert got.get(a, (None, 0.0)) == (best, top), a


def test_latest_job_excludes_own_team(spark):
    jobs = spark.createDataFrame(
        [(["k1", "k2"], "t1", 2005), (["k1"], "t2", 2003), (["k2"], "t3", 2001)], "keys array<string>, team string, season int"
    )
    asked = spark.createDataFrame([("q", "t1", ["k1", "k2"]), ("r", "t9", ["k2"]), ("s", "t3", ["zz"])], "ask string, team string, keys array<string>")
    got = {r["ask"]: r["last_seen_team"] for r in X.latest_by_any_key(asked, jobs, "ask", "keys", "team", "season", []).collect()}
    assert got == {"q": "t2", "r": "t1"}


def test_threshold_sweep_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [("m", s, float(rng.randint(1, 40)), rng.uniform(0, 45), 40) for s in (1, 2, 3) for _ in range(40)]
    df = spark.createDataFrame(rows, "model string, season int, actual_net_rank double, predicted_net_rank double, teams_ranked int")

    def brute(sample, band):
        if not sample:
            return float(band)
        best = None
        for t in range(1, 41):
            tp = sum(a <= band and p <= t for a, p in sample)
            fp = sum(a > band and p <= t for a, p in sample)
            fn = sum(a <= band and p > t for a, p in sample)
            prec = tp / (tp + fp) if tp + fp else 0.0
            rec = tp / (tp + fn) if tp + fn else 0.0
            f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
            if best is None or (f1, prec, -abs(t - band)) > best[0]:
                best = ((f1, prec, -abs(t - band)), float(t))
        return best[1]

    got = {(r["season"], r["band"]): r["threshold"] for r in M.out_of_fold_thresholds(df, ["model"], "season", (5, 20)).collect()}
    for s in (1, 2, 3):
        for band in (5, 20):
            assert got[s, band] == brute([(a, p) for _, t, a, p, _ in rows if t < s], band)


def test_auc_is_symmetric(spark):
    rows = [(int(i % 3 == 0), round((i * 37 % 11) / 11, 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "y int, p double")
    a = M.probability_scores(df, [], "y", "p").first()["auc"]
    b = M.probability_scores(df.withColumn("p", -F.col("p")), [], "y", "p").first()["auc"]
    pairs = [(p > q) + 0.5 * (p == q) for y, p in rows if y for z, q in rows if not z]
    assert abs(a - sum(pairs) / len(pairs)) < 1e-12 and abs(a + b - 1) < 1e-12


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    x[5, 0] = np.nan
    groups = np.array(["a", "b"])[rng.integers(0, 2, 80)]
    y = x[:, 1] * 2 + np.nan_to_num(x[:, 0]) + (groups == "a") + rng.normal(size=80) / 10
    rows = [(int(i), None if np.isnan(x[i, 0]) else float(x[i, 0]), float(x[i, 1]), str(groups[i]), float(y[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, u double, v double, g string, y double")
    cols = [np.ones(80)]
    for j in (0, 1):
        raw = x[:, j]
        missing = np.isnan(raw)
        filled = np.where(missing, np.median(raw[~missing]), raw)
        cols += [(filled - filled.mean()) / filled.std(), missing.astype(float)]
    cols += [(groups == "a").astype(float), (groups == "b").astype(float)]
    d = np.column_stack(cols)
    p = np.eye(d.shape[1]) * 3.0
    p[0, 0] = 0
    want = d @ np.linalg.solve(d.T @ d + p, d.T @ y)
    model = fit_ridge(df, ["u", "v"], F.col("y"), 3.0, "g")
    got = {r["i"]: r["z"] for r in df.select("i", model.predict().alias("z")).collect()}
    assert max(abs(got[i] - want[i]) for i in range(80)) < 1e-9


def _numpy_tree(x, r, rows, depth, min_leaf, bins):
    node = {"value": r[rows].mean()}
    if depth == 0 or len(rows) < 2 * min_leaf:
        return node
    best = (0.0, None, None)
    for f in range(x.shape[1]):
        u = np.unique(x[rows, f])
        if len(u) <= 1:
            continue
        cuts = (u[1:] + u[:-1]) / 2 if len(u) <= bins + 1 else u[[int(i * (len(u) - 1) / (bins + 1)) for i in range(1, bins + 1)]]
        for t in cuts:
            a, b = rows[x[rows, f] <= t], rows[x[rows, f] > t]
            if len(a) < min_leaf or len(b) < min_leaf:
                continue
            gain = r[a].sum() ** 2 / len(a) + r[b].sum() ** 2 / len(b) - r[rows].sum() ** 2 / len(rows)
            if gain > best[0] + 1e-9:
                best = (gain, f, t)
    if best[1] is None:
        return node
    f, t = best[1:]
    node.update(f=f, t=t, left=_numpy_tree(x, r, rows[x[rows, f] <= t], depth - 1, min_leaf, bins),
                right=_numpy_tree(x, r, rows[x[rows, f] > t], depth - 1, min_leaf, bins))
    return node


def _numpy_out(node, v):
    while "f" in node:
        node = node["left"] if v[node["f"]] <= node["t"] else node["right"]
    return node["value"]


def test_boosted_trees_match_numpy(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 4, 120), rng.normal(size=120), rng.integers(0, 30, 120)]).astype(float)
    y = (x[:, 0] > 1) * 2 + x[:, 1] + (x[:, 2] > 11) * (x[:, 0] > 0) + rng.normal(size=120) / 5
    pred = np.full(120, y.mean())
    for _ in range(3):
        tree = _numpy_tree(x, y - pred, np.arange(120), 2, 10, 6)
        pred = pred + 0.3 * np.array([_numpy_out(tree, v) for v in x])
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(120)], "i int, a double, b double, c double, y double")
    model = fit_boosted_trees(df, ["a", "b", "c"], F.col("y"), estimators=3, rate=0.3, min_leaf=10)
    got = {r["i"]: r["z"] for r in df.select("i", model.predict().alias("z")).collect()}
    assert max(abs(got[i] - pred[i]) for i in range(120)) < 1e-9


@pytest.mark.parametrize("bucket", [1_000_000, 25])
def test_models_grown_together_equal_single_ones(spark, bucket, monkeypatch):
    """Other columns, targets, depths and training seasons side by side; values in one bucket and in several."""
    monkeypatch.setattr(BO, "_BUCKET", bucket)
    monkeypatch.setattr(BO, "_CHUNK", 70)
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 4, 200), rng.normal(size=200), rng.integers(0, 30, 200)]).astype(float)
    gaps = rng.random((200, 3)) < 0.1
    y = np.column_stack([x[:, 1] + (x[:, 0] > 1), x[:, 2] * x[:, 0] / 20]) + rng.normal(size=(200, 2)) / 5
    season = rng.integers(2000, 2004, 200)
    rows = [(int(s), *[None if g else float(v) for v, g in zip(r, m)], *map(float, t)) for s, r, m, t in zip(season, x, gaps, y)]
    df = spark.createDataFrame(rows, "season int, a double, b double, c double, y0 double, y1 double").repartition(3)
    names, fill = ["a", "b", "c"], {"a": 1.0, "b": 0.25, "c": 12.0}
    jobs = [
        BO.BoostedJob(["a", "b", "c"], fill, 0, None, 3, 0.3, 2, 10, 6),
        BO.BoostedJob(["c", "b"], fill, 1, 2003, 2, 0.5, 3, 8, 4),
        BO.BoostedJob(["b"], fill, 1, 2001, 4, 0.1, 1, 5, 6),
        BO.BoostedJob([], fill, 0, None, 2, 0.1, 2, 5, 6),
    ]
    for job, model in zip(jobs, BO.fit_boosted_models(df, jobs, [F.col("y0"), F.col("y1")], F.col("season"))):
        at = [names.index(c) for c in job.columns]
        filled = np.where(gaps, [fill[c] for c in names], x)[:, at]
        seen = season < (job.before or 9999)
        pred, target = np.full(200, y[seen, job.target].mean()), y[:, job.target]
        for _ in range(job.estimators if at else 0):
            tree = _numpy_tree(filled, target - pred, np.flatnonzero(seen), job.max_depth, job.min_leaf, job.bins)
            pred = pred + job.rate * np.array([_numpy_out(tree, v) for v in filled])
        got = [r["z"] for r in spark.createDataFrame(rows, df.schema).select(model.predict().alias("z")).collect()]
        assert np.abs(np.array(got) - pred).max() < 1e-9


def test_logistic_solvers_agree(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 2))
    y = (x[:, 0] + rng.normal(size=150) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "roster_talent_a double, adj_b double, y int")
    best = fit_logistic(df, ["roster_talent_a", "adj_b"], "y")
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.zeros(2), np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))
    for _ in range(6000):
        e = 1 / (1 + np.exp(-(b + z @ w))) - y
        b -= 0.05 * e.mean()
        w -= 0.05 * (z.T @ e / len(y) + 0.02 * np.array([0.55, 1.25]) * w)
    assert max(abs(np.array(best.weights) - w)) < 1e-3 and abs(best.intercept - b) < 1e-3
    steps = fit_logistic(df, ["roster_talent_a", "adj_b"], "y", solver="descent", epochs=2)
    w, b = np.zeros(2), np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))
    for _ in range(2):
        e = 1 / (1 + np.exp(-(b + z @ w))) - y
        b -= 0.05 * e.mean()
        w -= 0.05 * (z.T @ e / len(y) + 0.02 * np.array([0.55, 1.25]) * w)
    assert max(abs(np.array(steps.weights) - w)) < 1e-9 and abs(steps.intercept - b) < 1e-9


SLOT_KNOWN = (
    "team string, known_pg double, known_backcourt double, known_big double, known_frontcourt double, "
    "returner_share double, transfer_share double"
)


def fill_in_order(rows, known):
    """Shares, weighted shares and needs of one team by a plain pass over (base, history, position, name, id)."""
    state = {"back": [known[0], known[1]], "front": [known[2], known[3]]}
    total = weighted = top = 0.0
    for base, history, position, *_ in sorted(rows, key=lambda r: (-r[0], r[3], r[4], r[1])):
        s, c = state["back" if position in ("pg", "guard") else "front"]
        need = max(min((5 - c) / 5, 1), 0)
        special = position in ("pg", "big")
        if special:
            need = (max(min((2 - s) / 2, 1), 0) + need) / 2
        share = min(max((history or 0.06) * (0.65 + 0.85 * need), 0), 0.22)
        fill = min(share / 0.08, 1)
        state["back" if position in ("pg", "guard") else "front"] = [s + fill * special, c + fill]
        total, weighted, top = total + share, weighted + base * share, max(top, share)
    return total, weighted / total, top, *[max(min((2 - state[c][0]) / 2, 1), 0) for c in ("back", "front")]


def test_slot_filling_equals_a_plain_pass(spark):
    """Full courts, tiny, negative and missing histories, repeated recruits and specialists that come late."""
    rng = random.Random(8)
    teams = {}
    for t, size in (("few", 4), ("many", 300), ("late", 120)):
        rows = [
            (rng.randint(1, 40) / 8, rng.choice([0.0, -0.1, 0.001, 0.05, 0.3, None]), rng.choice(["pg", "guard", "big", "wing"]), f"p{i:03d}", i)
            for i in range(size)
        ]
        if t == "late":
            rows = [(r[0] if r[2] in ("guard", "wing") else 0.01, *r[1:]) for r in rows]
        teams[t] = rows + rows[: size // 3] * 2
    known = {"few": (0.5, 1.0, 0.0, 0.5), "many": (0.0, 0.0, 0.0, 0.0), "late": (0.0, 4.5, 0.0, 4.0)}
    df = spark.createDataFrame(
        [(t, *r) for t, rows in teams.items() for r in rows],
        "team string, base double, history_share double, position string, player_name string, player_id int",
    )
    got = slot_filling(df, spark.createDataFrame([(t, *k, 0.2, 0.1) for t, k in known.items()], SLOT_KNOWN), ["team"])
    columns = ("projected_minutes_share_total", "need_adjusted_impact_percentile", "top_projected_minutes_share", "pg_need", "big_need")
    got = {r["team"]: [r[c] for c in columns] for r in got.collect()}
    assert set(got) == set(teams)
    for t, rows in teams.items():
        assert got[t] == pytest.approx(fill_in_order(rows, known[t]), abs=1e-9), t


def test_ridge_by_label_equals_the_dense_fit(spark):
    """Nulls in a feature and the target, blank, missing and new labels; more labels than one expression takes."""
    rng = np.random.default_rng(3)
    rows = [
        (i, None if i % 7 == 0 else float(rng.normal()), float(rng.normal()), [None, "", "a", "b", "c"][int(rng.integers(0, 5))], float(rng.normal()))
        for i in range(90)
    ]
    df = spark.createDataFrame(rows, "i int, u double, v double, g string, y double")
    dense = df.withColumn("p", fit_ridge(df, ["u", "v"], F.col("y"), 3.0, "g").predict())
    model = fit_ridge_by_label(df, ["u", "v"], F.col("y"), 3.0, "g")
    got = {r["i"]: r["p"] for r in model.score(df, "p").collect()}
    assert len(got) == len(rows)
    assert all(abs(got[r["i"]] - r["p"]) < 1e-9 for r in dense.collect())
    new = model.score(df.where("i = 5").withColumn("g", F.lit("other")), "p").first()["p"]
    assert new == pytest.approx(model.score(df.where("i = 5").withColumn("g", F.lit(None).cast("string")), "p").first()["p"])
    many = spark.range(100_000).selectExpr("cast(id as string) as g", "cast(id % 13 as double) as u", "cast(id % 5 as double) as y")
    many = many.union(many.selectExpr("g", "u", "cast(null as double)"))
    model = fit_ridge_by_label(many, ["u"], F.col("y"), 1.0, "g")
    assert model.effects.count() == 100_000 and model.score(many, "p").where("p is null").isEmpty()


def test_rows_without_a_label_pass_no_join(spark, capsys):
    """Only labelled rows are dealt for the join with the label terms, and with the features already summed up."""
    df = spark.range(200).selectExpr(
        "id", "case when id % 10 = 0 then concat('g', id % 3) when id % 2 = 0 then '' end as g", "cast(id % 13 as double) as u", "cast(id % 5 as double) as y"
    )
    model = fit_ridge_by_label(df, ["u"], F.col("y"), 1.0, "g")
    scored = model.score(df, "p")
    assert scored.columns == [*df.columns, "p"] and scored.count() == 200 and scored.where("p is null").isEmpty()
    scored.explain()
    plan = capsys.readouterr().out
    assert plan.index("Union") < plan.index("Join") and "xxhash64" not in plan
    left = model.score(df.where("g is null or g = ''"), "p")
    assert left.count() == 180 and {r["p"] for r in left.collect()} <= {r["p"] for r in scored.collect()}


def test_weighted_means_differ_on_null(spark):
    df = spark.createDataFrame([(1.0, 10.0), (None, 10.0), (5.0, 0.0)], "v double, w double")
    r = df.agg(
        A.weighted_mean(F.col("v"), F.col("w")).alias("skip"), A.weighted_mean(F.col("v"), F.col("w"), True).alias("zero")
    ).first()
    assert (r["skip"], r["zero"]) == (1.0, 0.5)


def test_latest_by_any_key_takes_the_first_team(spark):
    from tipoff.operators.matching import latest_by_any_key

    rows = spark.createDataFrame([(["k"], t, 2020) for t in "BCA"], "keys array<string>, team string, season int")
    asked = spark.createDataFrame([(1, ["k"], "Z"), (2, ["k"], "A")], "id int, keys array<string>, team string")
    got = {r["id"]: r["last_seen_team"] for r in latest_by_any_key(asked, rows, "id", "keys", "team", "season", []).collect()}
    assert got == {1: "A", 2: "B"}


def test_cascade_match_spreads_blank_keys(spark):
    from tipoff.operators.matching import cascade_match

    people = spark.createDataFrame([("1", "ann", "x", 5), ("", "bob", "y", 6)], "player_id string, player_key string, source_team_key string, v int")
    ledger = spark.createDataFrame(
        [("1", "?", "?"), ("", "bob", "y"), (None, "bob", None), ("", "", ""), (None, None, None)], "player_id string, player_key string, source_team_key string"
    )
    got = [r["match_method"] for r in cascade_match(ledger, people, payload=["v"]).collect()]
    assert sorted(map(str, got)) == sorted(["player_id", "player_name_source_team", "player_name_only", "None", "None"])


def test_coded_chunks_hold_every_value(spark, monkeypatch):
    from tipoff.operators import boosting as BO

    monkeypatch.setattr(BO, "_CHUNK", 3)
    data = [(2000.0, [1.5, None], [1.0]), (2001.0, [-2.0, 7.0], [2.0]), (2002.0, [1.5, float("nan")], [3.0]), (2003.0, [0.0, 7.0], [4.0])]
    rows = spark.createDataFrame(data, "season double, x array<double>, y array<double>").coalesce(1)
    got = []
    for r in BO._coded(rows, 2).collect():
        sizes = np.frombuffer(r["sizes"], "i4")
        values = np.split(np.frombuffer(r["values"]), np.cumsum(sizes)[:-1])
        codes = np.frombuffer(r["codes"], "i4").reshape(2, r["rows"])
        got += list(zip(np.frombuffer(r["season"]), *[v[c] for v, c in zip(values, codes)], np.frombuffer(r["y"])))
    want = [(s, *[np.nan if v is None else v for v in x], *y) for s, x, y in data]
    np.testing.assert_array_equal(np.array(got), np.array(want))
