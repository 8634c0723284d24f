from kinrank.operators import cochange as co


def _changes(spark, groups):
    rows = [(g, item) for g, items in enumerate(groups) for item in items]
    return spark.createDataFrame(rows, "group_id long, item string")


def test_normalizes_cochange_score_per_target(spark):
    ch = _changes(spark, [["src/a.rs", "src/b.rs"], ["src/a.rs", "src/b.rs"], ["src/a.rs", "src/c.rs"]])
    s = {(r.target, r.candidate): r for r in co.cochange_scores(co.cochange_pairs(ch)).collect()}
    best, weaker = s[("src/a.rs", "src/b.rs")], s[("src/a.rs", "src/c.rs")]
    assert best.commit_count == 2 and weaker.commit_count == 1
    assert best.score == 1.0 and weaker.score < best.score and abs(weaker.score - 0.5) < 1e-12
    assert s[("src/b.rs", "src/a.rs")].commit_count == 2      # both directions


def test_group_size_limits_and_duplicates(spark):
    big = [f"f{i}" for i in range(65)]
    ch = _changes(spark, [["a"], big, ["a", "b", "a"]])
    rows = co.cochange_pairs(ch).collect()
    assert {(r.target, r.candidate) for r in rows} == {("a", "b"), ("b", "a")}
    assert abs(rows[0].weighted_count - 2 ** -0.5) < 1e-12


def test_history_limit_and_change_types(spark):
    rows = [(1, "a", "M", "2024-01-01"), (1, "b", "M", "2024-01-01"), (2, "a", "D", "2024-01-03"),
            (2, "c", "D", "2024-01-03"), (3, "a", "A", "2024-01-02"), (3, "d", "A", "2024-01-02")]
    ch = spark.createDataFrame(rows, "group_id long, item string, change_type string, ts string") \
        .selectExpr("group_id", "item", "change_type", "cast(ts as timestamp) ts")
    kept = co.limit_history(co.filter_change_types(ch), 1)
    assert {r.group_id for r in kept.collect()} == {3}
    assert co.limit_history(ch, 0).count() == 0


def test_newest_groups_by_counting(spark, monkeypatch):
    import random
    rng = random.Random(5)
    rows = [(g, f"i{k}", rng.choice([None, 5, 5, 5, 70, 10 ** 15, -3, g])) for g in range(300) for k in range(rng.randint(1, 3))]
    newest = {}
    for g, _, t in rows:
        newest[g] = max(newest.get(g, -10 ** 18), -10 ** 18 if t is None else t)
    order = sorted(newest, key=lambda g: (newest[g], g), reverse=True)
    ch = spark.createDataFrame(rows, "group_id long, item string, ts long")
    for few in (10_000, 3):
        monkeypatch.setattr(co, "FEW", few)
        monkeypatch.setattr(co, "BUCKETS", 1024 if few > 3 else 16)
        for n in (1, 17, 250, 300, 301):
            assert {r.group_id for r in co.recent_groups(ch, n).collect()} == set(order[:n])
        kept = co.limit_history(ch, 40)
        assert {r.group_id for r in kept.collect()} == set(order[:40])
        assert kept.count() == sum(g in set(order[:40]) for g, _, _ in rows)
    named = ch.selectExpr("cast(group_id as string) group_id", "item", "ts")
    assert co.recent_groups(named, 5).count() == 5 and co.limit_history(named, 0).count() == 0


def test_uncapped_groups_equal_brute_force_and_drops_are_observed(spark):
    from pyspark.sql import Observation
    big = [f"f{i}" for i in range(300)]
    groups = [big, big[:70], ["a", "f0"], ["solo"]]
    ch = _changes(spark, groups)
    got = {(r.target, r.candidate): (r.commit_count, r.weighted_count) for r in co.cochange_pairs(ch, max_size=None).collect()}
    want = {}
    for items in groups:
        for a in items:
            for b in items:
                if a != b:
                    c, w = want.get((a, b), (0, 0.0))
                    want[a, b] = (c + 1, w + len(items) ** -0.5)
    assert got.keys() == want.keys()
    assert all(got[k][0] == c and abs(got[k][1] - w) < 1e-9 for k, (c, w) in want.items())
    seen = Observation("dropped")
    assert co.cochange_pairs(ch, dropped=seen).count() == 2
    assert seen.get == {"too_small": 1, "too_large": 2, "items_of_large": 370}


def test_large_groups_by_blocks_rank_as_the_join_does(spark, monkeypatch):
    import random
    from kinrank.operators.topk import top_n_per_key
    rng = random.Random(2)
    rows = [(g, rng.randrange(90)) for g in range(25) for _ in range(rng.choice([1, 3, 40, 120]))] + [(None, 1), (3, None), (4, 5), (4, 5)]
    ch = spark.createDataFrame(rows, "group_id long, item long")
    want = sorted(map(str, top_n_per_key(co.cochange_scores(co.cochange_pairs(ch, max_size=200)), "target", "score", "candidate", 3)
                      .selectExpr("target", "candidate", "round(weighted_count, 9)", "commit_count", "round(score, 9)", "rank").collect()))

    def got():
        out = co.cochange_topk(ch, n=3, max_size=200)
        return sorted(map(str, out.selectExpr("target", "candidate", "round(weighted_count, 9)", "commit_count", "round(score, 9)", "rank").collect()))
    monkeypatch.setattr(co, "cochange_pairs", None)           # no pairs are formed by a join
    assert got() == want and len(want) > 100
    for name, value in (("BLOCK_TOUCHES", 400), ("TASK_TOUCHES", 300), ("MEMBERS", 30)):
        monkeypatch.setattr(co, name, value)
    assert got() == want


def test_scores_shuffle_the_pairs_once(spark):
    ch = _changes(spark, [[f"f{i}" for i in range(g, g + 5)] for g in range(200)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = co.cochange_scores(co.cochange_pairs(ch))
        assert len(out.collect()) > 1000
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Reused" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bitmaps_of_large_groups_find_the_best_partners(monkeypatch):
    """The partners that may be among the best equal brute force, ties and unequal weights included, and few others come back."""
    import numpy as np
    monkeypatch.setattr(co, "DENSE", 2)
    looked = []
    plain = co._Members._all
    monkeypatch.setattr(co._Members, "_all", lambda self, *a: looked.append(1) or plain(self, *a))
    rng, most = np.random.default_rng(3), 0
    for case in range(60):
        n_items, n_groups, n = int(rng.integers(2, 400)), int(rng.integers(1, 14)), int(rng.integers(1, 6))
        member = rng.random((n_groups, n_items)) < rng.choice([0.02, 0.3, 0.9], n_groups)[:, None]
        if case % 3 == 0:
            member[:, n_items // 2:] = member[:, :n_items - n_items // 2]               # the same groups again: ties
        groups, items = np.nonzero(member)
        sizes = member.sum(axis=1) + rng.choice([0, 1, 500], n_groups)                  # members of other blocks count
        known = co._Members(groups * 10, items * 3 + 1)
        for target in rng.choice(n_items + 1, 5).tolist():
            own = np.flatnonzero(member[:, target] if target < n_items else member[:, 0])
            if not len(own) or not len(items):
                continue
            total, times = (member[own] / np.sqrt(sizes[own])[:, None]).sum(axis=0), member[own].sum(axis=0)
            score = np.round(total / max(1e-300, np.delete(total, target).max() if target < n_items else total.max()), 9)
            want = [i for i in np.lexsort((np.arange(n_items), -score)).tolist() if i != target and times[i]][:n]
            place, weighted, count = known.partners(target * 3 + 1, own * 10, sizes[own].astype(float), n)
            found = {int((known.items[p] - 1) // 3): (w, c) for p, w, c in zip(place, weighted, count)}
            assert set(want) <= set(found) and target not in found
            assert all(abs(found[i][0] - total[i]) < 1e-12 and found[i][1] == times[i] for i in found)
            assert min((score[i] for i in found), default=0) >= min((score[i] for i in want), default=0) - 1e-8
            most = max(most, len(found) - len(want))
    assert most <= 12 and len(looked) < 200


def test_uncapped_query_reads_every_day(spark, tmp_path):
    import datetime as dt
    import __spark_entry__ as E
    orders = [(k, dt.datetime(1993 + k, 2, 3, k)) for k in range(4)] + [(9, dt.datetime(1993, 2, 3, 20)), (10, None)]
    lines = [(k, p, "N") for k, _ in orders for p in ((1, 2) if k != 9 else (3, 3))] + [(3, None, "N"), (77, 5, "N")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.target, r.candidate): (r.commit_count, r["rank"]) for r in E.queries()["cochange_uncapped"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): (4, 1), (2, 1): (4, 1), (1, 3): (1, 2), (2, 3): (1, 2), (3, 1): (1, 1), (3, 2): (1, 2)}
