"""The walk against a plain model of its rules, and what must hold for every sequence."""

import random
import uuid

import numpy as np
import pytest

from lattica.operators import graph as G
from lattica.operators import sampling as M
from lattica.sources.annotation import SType


def model(seed, out, into, times, obs, rank, size, c):
    """The rules, one step at a time."""
    queue, seen, rows, cells = [(seed, True)], set(), [], 0
    while queue:
        at = next((i for i, q in enumerate(queue) if q[1]), 0)
        row, _ = queue.pop(at)
        if cells >= c.sequence_length or len(rows) >= c.max_rows_per_seq:
            break
        if row in seen:
            continue
        seen.add(row)
        rows.append(row)
        cells += min(size, c.sequence_length - cells)
        queue += [(p, True) for p in sorted(out.get(row, [])) if p not in seen]
        kids = sorted({k for k in into.get(row, []) if k not in seen and (obs is None or times.get(k) is None or times[k] <= obs)})
        if len(kids) > c.bfs_child_width:
            kids = sorted(kids, key=lambda k: rank[seed, row, k])[: c.bfs_child_width]
        queue += [(k, False) for k in kids]
    return rows


@pytest.mark.parametrize("trial", range(2))
def test_walk_against_model(spark, tmp_path, trial):
    rng = random.Random(trial)
    n = 60
    edges = [(a, rng.randrange(n)) for a in range(n) for _ in range(rng.randrange(4))]
    edges = [(a, b) for a, b in edges if a != b]
    times = {i: rng.randrange(100) for i in range(n) if rng.random() < 0.7}
    c = M.SamplerConfig(sequence_length=40, bfs_child_width=2, max_rows_per_seq=15)
    seeds = [(i, rng.randrange(n), rng.choice([None, 50, 90])) for i in range(8)]

    def written(df):
        p = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(p)
        return spark.read.schema(df.schema).parquet(p)

    e = spark.createDataFrame(edges, "src long, dst long")
    t = spark.createDataFrame(list(times.items()), "row_id long, us long")
    got = M.sampled(spark, spark.createDataFrame(seeds, "seq long, row_id long, obs long"), e, t, [(0, 3)], c, written).toPandas()
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    hashes = {(r.seq, r.parent): r.h for r in spark.createDataFrame([(q, p) for q, *_ in seeds for p in into], "seq long, parent long").selectExpr("seq", "parent", f"xxhash64({c.seed}, seq, parent) AS h").collect()}
    for seq, seed, obs in seeds:
        rank = {}
        for p in into:
            kids = sorted((k for k in set(into[p]) if obs is None or times.get(k) is None or times[k] <= obs), key=lambda k: (times.get(k, -1), k))
            h = hashes[seq, p]
            for i in range(len(kids)):
                rank[seed, p, kids[((h >> 8) % len(kids) + i * G.STEPS[h % len(G.STEPS)]) % len(kids)]] = i
        own = got[got.seq == seq].sort_values("seq_row_id")
        assert own.row_id.tolist() == model(seed, out, into, times, obs, rank, 3, c)
        assert own.first_pos.tolist() == [min(3 * i, 40) for i in range(len(own))]


def test_children_of_a_hub_in_time(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 16)
    rng = random.Random(3)
    times = {i: rng.randrange(50) for i in range(1, 101) if i % 3}
    e = spark.createDataFrame([(i, 0) for i in range(1, 101)] + [(1, 0)], "src long, dst long")
    index = G.child_index(e, spark.createDataFrame(list(times.items()), "row_id long, us long"))
    asked = spark.createDataFrame([(q, 0, obs) for q, obs in enumerate((None, -1, 0, 20, 49))] + [(9, 5, None)], "seq long, row_id long, obs long")
    want = {q: {i for i in range(1, 101) if obs is None or times.get(i) is None or times[i] <= obs} for q, obs in enumerate((None, -1, 0, 20, 49))}
    assert {r.seq: r.total for r in G.eligible(asked, index).collect()} == {q: len(x) for q, x in want.items()} | {9: 0}
    for width in (5, 200):
        got = {}
        for r in G.top_children(asked, index, width).collect():
            got.setdefault(r.seq, []).append(r.row_id)
        for q, x in want.items():
            assert len(set(got[q])) == len(got[q]) == min(width, len(x)) and set(got[q]) <= x


def test_budgets_cut():
    c = M.SamplerConfig(sequence_length=7, bfs_child_width=5, max_rows_per_seq=3)
    chain = {i: [i + 1] for i in range(9)}
    visited, cells, complete = M.walk(0, chain, {}, {}, lambda r: 2, c, set(range(10)))
    assert list(visited) == [0, 1, 2] and cells == 6 and complete
    visited, cells, _ = M.walk(0, chain, {}, {}, lambda r: 9, c, set(range(10)))
    assert list(visited) == [0] and cells == 7


def test_unknown_rows_are_told():
    assert not M.walk(0, {0: [1]}, {}, {}, lambda r: 1, M.SamplerConfig(), {0})[2]


def test_target_position():
    kinds = [SType.IGNORED, SType.IDENTIFIER, SType.NUMERICAL, SType.NUMERICAL]
    assert M.target_position(kinds, SType.NUMERICAL) == 1 and M.target_position(kinds, SType.BOOLEAN) == 0


def test_each_pair_of_masks_is_made_once(spark, monkeypatch):
    """Against all pairs: sequences of more rows than a block, a hub, a row that refers to itself, repeated references; no pair is shuffled."""
    monkeypatch.setattr(M, "PAIRED", 4)
    rng = random.Random(6)
    cells = [(q, r * 3 + c, r, c + q % 2) for q in range(3) for r in range(11) for c in range(3) if (q, r, c) != (1, 2, 1)]
    refer = {(q, rng.randrange(11), rng.randrange(11)) for q in range(3) for _ in range(9)} | {(0, i, 0) for i in range(11)} | {(1, 3, 3)}
    df, adj = spark.createDataFrame(cells, "seq int, pos long, seq_row_id int, column_idx int"), spark.createDataFrame([*refer, *refer], "seq int, i int, j int")
    want = set()
    for q, i, ri, ci in cells:
        for p, j, rj, cj in cells:
            flags = ri == rj or (q, ri, rj) in refer, (q, rj, ri) in refer or i == j, ci == cj
            if p == q and any(flags):
                want.add((q, i, j, *flags))
    out = M.masks(df, adj)
    got = list(map(tuple, out.collect()))
    assert len(got) == len(want) and set(got) == want
    top = out._jdf.queryExecution().executedPlan().toString().split("Union", 1)[0]
    assert "Aggregate" not in top and "Exchange" not in top


def plain_rank(a, used):
    r = len(a)
    near = [[j for j in range(r) if a[i][j] and i != j] for i in range(r)]
    order, seen = [], [False] * r
    while len(order) < r:
        free = [i for i in range(r) if not seen[i] and used[i]]
        start = min(free, key=lambda i: len(near[i])) if free else seen.index(False)
        seen[start] = True
        q = [start]
        while q:
            x = q.pop(0)
            order.append(x)
            for k in sorted((k for k in near[x] if not seen[k]), key=lambda k: len(near[k])):
                if not seen[k]:
                    seen[k] = True
                    q.append(k)
    order.reverse()
    return [order.index(i) for i in range(r)]


def test_reverse_cuthill_mckee():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 12):
        for _ in range(10):
            a, used = rng.random((n, n)) < 0.25, rng.random(n) < 0.7
            assert M.reverse_cuthill_mckee(a, used).tolist() == plain_rank(a, used)


def test_permutations_put_padding_last():
    rows, cols = np.array([0, 0, 1, 1, 0, 0]), np.array([0, 1, 0, 1, 0, 0])
    padding = np.array([0, 0, 0, 0, 1, 1], bool)
    for v in M.permutations(rows, cols, padding, np.array([[0, 1, 0], [0, 0, 0], [0, 0, 0]], bool)).values():
        assert sorted(v.tolist()) == list(range(6)) and set(v[-2:].tolist()) == {4, 5}
    assert M.permutations(rows, cols, padding, np.zeros((3, 3), bool))["col_perm"].tolist() == [0, 2, 1, 3, 4, 5]


def test_reached_against_listing_all(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(6)) for _ in range(150)] + [(a, 40 + a % 3) for a in range(6)] + [(100 + i, rng.choice([0, 1])) for i in range(60)] * 2
    e = spark.createDataFrame(edges, "src long, dst long")
    times = spark.createDataFrame([(i, rng.choice([None, rng.randrange(9)])) for i in range(160)], "row_id long, us long")
    front = [(q, rng.randrange(45), [None, 3, 7][q % 3]) for q in range(60) for _ in range(rng.randrange(1, 8))]
    df = spark.createDataFrame(front, "seq long, row_id long, obs long")
    want, meet = {}, 0
    for r in G.expanded(df.distinct(), e, times).collect():
        x = want.setdefault((r.relation, r.row_id), [0, set(), set()])
        x[0] += 1
        x[1].add(r.seq)
        x[2].add(r.parent)
    got = {(r.relation, r.row_id): (r.n, r.sequences) for r in G.reached(df, e, times).collect()}
    assert got == {k: (n, len(q)) for k, (n, q, _) in want.items()}
    assert any(len(p) > 1 for *_, p in want.values()) and any(len(p) == 1 and len(q) > 1 for _, q, p in want.values())
    assert G.reached(df.filter("false"), e, times).count() == 0


@pytest.mark.parametrize("width", [3, 500])
def test_walks_over_hubs_are_those_over_rows(spark, monkeypatch, width):
    """Whether a row's children stand beside it or in blocks of an index, a walk is the same, and no step reads all parts."""
    from lattica.operators import store as T
    from lattica.sources.database import written

    rng = random.Random(5)
    edges = [(i, rng.choice([0, 1, 2, 900, 901])) for i in range(10, 800)] + [(i, 10 + i % 50) for i in range(1000, 1300)]
    e = spark.createDataFrame(edges, "src long, dst long")
    t = spark.createDataFrame([(i, rng.randrange(100)) for i in range(10, 700)], "row_id long, us long")
    seeds = spark.createDataFrame([(i, rng.choice([0, 20, 700, 1100, 5000]), rng.choice([None, 50])) for i in range(20)], "seq long, row_id long, obs long")
    c = M.SamplerConfig(sequence_length=120, bfs_child_width=width, max_rows_per_seq=40)
    keep = lambda df: written(df, "walk")
    run = lambda: sorted(map(tuple, M.sampled(spark, seeds, e, t, [(0, 2)], c, keep).collect()))
    plain = run()
    monkeypatch.setattr(T, "HUB", 20)
    monkeypatch.setattr(G, "BLOCK", 16)
    assert run() == plain and len(plain) > 100
    store = T.RowStore.build(e, t)
    asked = written(spark.createDataFrame([(1, 700, None, 0, 9)], "seq long, row_id long, obs long, since int, upto int"), "asked")
    found = store.look_up(asked, 1)
    assert [(r.row_id, r.total) for r in found.collect()] == [(700, 0)]
    assert len(found.inputFiles()) < len(store.rows.inputFiles())


def test_places_of_a_hub_that_spans_ranges(spark):
    edges = [(7, i % 900) for i in range(4000)] + [(i, 3) for i in range(5)] + [(9, i) for i in range(700)]
    got = {}
    for r in G.flat_adjacency(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect():
        got.setdefault(r.row_id, []).append((r.place, r.neighbor))
    for src in {a for a, _ in edges}:
        want = sorted(b for a, b in edges if a == src)
        assert sorted(got.pop(src)) == list(enumerate(want))
    assert not got


def test_inclusions_against_sets(spark):
    from lattica.operators import profile as P

    rng = random.Random(8)
    tables = {c: [rng.choice([None, *range(n)]) for _ in range(200)] for c, n in (("a", 5), ("b", 30), ("c", 31), ("none", 0))}
    parts = [(c, spark.createDataFrame([(x,) for x in v], "v long"), "v") for c, v in tables.items()]
    got = {(r.col, r.holder): (r.total, r.matched) for r in P.inclusions(parts).collect()}
    for a, x in tables.items():
        for b, y in tables.items():
            own, there = [v for v in x if v is not None], set(y) - {None}
            hit = sum(v in there for v in own)
            assert a == b or got.get((a, b), (len(own), 0)) == (len(own), hit)


def test_only_children_of_those_asked_for_are_indexed(spark, monkeypatch):
    from lattica.plans import registered as P

    seen = []
    index = G.child_index
    monkeypatch.setattr(G, "child_index", lambda e, t: seen.append((e.select("dst").distinct(), e.count(), t.count())) or index(e, t))
    sf = "/root/testdata/sf0.001"
    assert P.child_topw(spark, sf).count() > 0
    d = P.db(spark, sf)
    (dst, n, times), first = seen[0], d.offsets["customer"]
    assert n == d.counts["orders"] + d.counts["events"] == times
    assert all(first <= r.dst < first + d.counts["customer"] for r in dst.collect())


@pytest.mark.parametrize("name", ["sequence_cells", "sequence_edges"])
def test_ended_walks_have_all_that_is_asked(spark, name):
    """No table is read or joined for the cells and references of visited rows: walks have the references, tables the cells."""
    from lattica.registry import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not [f for f in df.inputFiles() if "testdata" in f]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_references_and_children_of_walks(spark):
    """Links of walks are those of their rows; children that no budget can reach are not asked for, and what is visited stays the same."""
    from lattica.operators.store import RowStore
    from lattica.sources.database import written

    rng = random.Random(9)
    edges = [(i, rng.choice([0, 1, 2])) for i in range(10, 200)] + [(i, 10 + i % 50) for i in range(200, 400)] + [(i, 10 + i % 7) for i in range(200, 400)]
    e = written(spark.createDataFrame(edges, "src long, dst long"), "edges")
    t = spark.createDataFrame([(i, rng.randrange(100)) for i in range(10, 300)], "row_id long, us long")
    seeds = spark.createDataFrame([(i, rng.choice([0, 20, 210, 9000]), rng.choice([None, 50])) for i in range(20)], "seq long, row_id long, obs long")
    store, asked = RowStore.build(e, t), []
    look_up = store.look_up
    store.look_up = lambda df, *a: asked.append(df.persist()) or look_up(df, *a)
    for width in (4, 1000):
        c = M.SamplerConfig(sequence_length=60, bfs_child_width=width, max_rows_per_seq=25)
        walks = M.walks(spark, seeds, e, t, [(0, 3)], c, lambda df: written(df, "walk"), store, links=True)
        rows = M.rows_of(walks)
        pairs = lambda df: sorted(map(tuple, df.select("seq", "i", "j").collect()))
        from pyspark.sql import functions as F

        assert pairs(walks.select("seq", F.inline(F.arrays_zip("i", "j")))) == pairs(M.row_adjacency(rows, e))
    counts = [(df.filter("upto = 0").count(), df.filter("upto > 0").count()) for df in asked]
    assert sum(a for a, _ in counts) > sum(b for _, b in counts) > 0


def test_walks_of_all_children_ascending(spark, monkeypatch):
    """Where no children are drawn, those of least number that the budget can reach do, of hubs too: against the rules, one step at a time."""
    from lattica.operators import store as T
    from lattica.sources.database import written

    monkeypatch.setattr(T, "HUB", 20)
    monkeypatch.setattr(T, "LEAST", 12)
    monkeypatch.setattr(G, "BLOCK", 16)
    rng = random.Random(2)
    edges = [(i, rng.choice([0, 1])) for i in range(10, 150)] + [(i, 10 + i % 40) for i in range(150, 300)]
    times = {i: 60 if i < 60 else rng.randrange(100) for i in range(10, 250)}  # the hubs' first children are late
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    seeds = [(i, rng.choice([0, 1, 20, 160]), rng.choice([None, 50])) for i in range(16)]
    c = M.SamplerConfig(sequence_length=500, bfs_child_width=1000, max_rows_per_seq=9)
    e, t = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(list(times.items()), "row_id long, us long")
    got = M.sampled(spark, spark.createDataFrame(seeds, "seq long, row_id long, obs long"), e, t, [(0, 2)], c, lambda df: written(df, "walk")).toPandas()
    for seq, seed, obs in seeds:
        assert got[got.seq == seq].sort_values("seq_row_id").row_id.tolist() == model(seed, out, into, times, obs, {}, 2, c)
