"""Graph preparation, samplers, primitives, sources, the loop and its checkpoints."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmesh.config import Config, Noise, Strategy
from quillmesh.functions import rng
from quillmesh.operators import graph as G
from quillmesh.operators import initial as I
from quillmesh.operators import membership as M
from quillmesh.operators import primitives as R
from quillmesh.operators import samplers as S
from quillmesh.operators.numbering import number_rows
from quillmesh.operators.split import heldout_count, random_nonlinks, split_edges, training_ppx_edges
from quillmesh.plans.learner import Learner
from quillmesh.queries import oracle_sql
from quillmesh.sources.edges import customer_supplier, metrics, part_supplier, read_dataset, read_edge_list, write_dataset


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "u long, v long")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def planted(spark):
    """Four blocks of 25 vertices, dense inside and sparse between."""
    import numpy as np

    g = np.random.default_rng(1)
    found = [(i, j) for i in range(100) for j in range(i + 1, 100) if g.random() < (0.4 if i // 25 == j // 25 else 0.01)]
    return edges_of(spark, found)


@pytest.fixture(scope="module")
def split(spark, planted):
    from quillmesh.storage import stored

    edges = stored(planted, "test")
    return split_edges(edges, 100, 0.1, 7)


def test_canonical(spark):
    df = edges_of(spark, [(2, 1), (1, 2), (3, 3), (1, None), (None, None), (5, 4)])
    assert rows(G.canonical(df)) == [(1, 2), (4, 5)]
    assert rows(G.canonical(df.limit(0))) == []


def test_dense_ids_are_oriented_again(spark):
    e = edges_of(spark, [(10, 300), (20, 300), (10, 20)])
    ids = G.vertex_ids(e)
    assert rows(ids) == [(10, 0), (20, 1), (300, 2)]
    assert rows(G.dense(e, ids)) == [(0, 1), (0, 2), (1, 2)]


def test_adjacency_is_symmetric(planted):
    known = set(rows(planted))
    for n, neighbors in rows(G.adjacency(planted)):
        assert neighbors == sorted(neighbors)
        for m in neighbors:
            assert (min(n, m), max(n, m)) in known
    assert sum(len(x[1]) for x in rows(G.adjacency(planted))) == 2 * len(known)
    assert G.max_fan_out(planted).first()[0] == max(len(x[1]) for x in rows(G.adjacency(planted)))


def test_random_edge_exists(planted):
    known = set(rows(planted))
    for draw in range(3):
        n, m = G.random_edge(planted, 3, draw).first()
        assert (min(n, m), max(n, m)) in known


def test_numbering(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = rows(number_rows(df, ["x"]))
    assert [p for _, p in got] == list(range(5000))


def test_split_counts(split, planted):
    e = planted.count()
    h = heldout_count(e, 0.1)
    assert h == e - math.ceil(0.95 * e)
    links, nonlinks, train = (set(rows(x)) for x in (split.heldout_links, split.heldout_nonlinks, split.train))
    assert len(links) == len(nonlinks) == h and len(train) == e - h
    assert links | train == set(rows(planted)) and not links & train
    assert not nonlinks & (links | train) and all(u < v for u, v in nonlinks)


def test_split_without_heldout(spark):
    s = split_edges(edges_of(spark, [(0, 1), (1, 2)]), 3, 0.0, 1)
    assert s.heldout.count() == 0 and s.train.count() == 2


def test_nonlinks_of_a_complete_graph(spark):
    full = edges_of(spark, [(i, j) for i in range(5) for j in range(i + 1, 5)])
    with pytest.raises(ValueError, match="non-links"):
        random_nonlinks(full, 5, 1, 1)
    almost = full.where("not (u = 1 and v = 3)")
    assert rows(random_nonlinks(almost, 5, 1, 1)) == [(1, 3)]


def test_training_ppx_edges(split):
    got = training_ppx_edges(split, 0.05, 3).collect()
    links = {(r.u, r.v) for r in got if r.y}
    assert links <= set(rows(split.train)) and len(links) == int(0.05 * split.train.count())
    others = {(r.u, r.v) for r in got if not r.y}
    assert len(others) == len([r for r in got if not r.y]) and not others & (set(rows(split.train)) | {(r.u, r.v) for r in split.heldout.collect()})


def test_membership(spark):
    e, p = edges_of(spark, [(0, 1), (2, 5)]), edges_of(spark, [(1, 0), (2, 5), (5, 6)])
    assert rows(M.flag(p, e)) == [(1, 0, 1), (2, 5, 1), (5, 6, 0)]
    assert rows(M.members(p, e)) == [(1, 0), (2, 5)]
    assert rows(M.others(p, e)) == [(5, 6)]


@pytest.mark.parametrize("strategy", list(Strategy))
def test_samplers(split, strategy):
    c = Config(k=4, mini_batch=12, neighbors=5, seed=9)
    batch = S.SAMPLERS[strategy](split, c, 3)
    got, train = rows(batch.edges), set(rows(split.train))
    held = {(r.u, r.v) for r in split.heldout.collect()}
    assert len(got) == len(set(got)) > 0 and all(u < v for u, v in got)
    assert not set(got) & held
    link = strategy in (Strategy.NODE_LINK, Strategy.BF_LINK) or (strategy in (Strategy.NODE, Strategy.BF) and S.coin(c, 3))
    assert set(got) <= train if link else not set(got) & train
    n, e = 100, split.n_edges
    want = {(False, True): float(n), (False, False): 2 * e / 12, (True, True): e / 12, (True, False): (n * (n - 1) / 2 - e) / 12}
    assert batch.weight == want["BF" in strategy.value, link]
    if strategy is Strategy.NODE_LINK:
        common = set.intersection(*[set(x) for x in got])
        assert common and set(got) == {x for x in train if common & set(x)}
    else:
        assert len(got) == 12 or strategy is Strategy.NODE
    again = rows(S.SAMPLERS[strategy](split, c, 3).edges)
    assert again == got


def test_neighbor_sample(spark):
    nodes = spark.range(40).withColumnRenamed("id", "n")
    got = rows(S.neighbor_sample(nodes, 12, 11, 1, 1).where("n < 12"))
    for n in range(12):
        assert sorted(m for k, m in got if k == n) == [m for m in range(12) if m != n]
    with pytest.raises(ValueError, match="neighbours"):
        S.neighbor_sample(nodes, 11, 11, 1, 1)


def test_random_numbers(spark):
    df = spark.range(20000).select(rng.uniform("t", 1, F.col("id")).alias("u"), rng.normal("t", 1, F.col("id")).alias("z"), rng.exponential(2.0, "t", 1, F.col("id")).alias("g")).toPandas()
    assert 0 < df.u.min() and df.u.max() < 1 and abs(df.u.mean() - 0.5) < 0.01
    assert abs(df.z.mean()) < 0.03 and abs(df.z.std() - 1) < 0.03
    assert abs(df.g.mean() - 2) < 0.06
    first = spark.range(5).select(rng.uniform("t", 1, F.col("id")).alias("u"), rng.normal("t", 1, F.col("id")).alias("z")).collect()
    assert [r.u for r in first] == [rng.uniform_value("t", 1, i) for i in range(5)]
    assert [r.z for r in first] == pytest.approx([rng.normal_value("t", 1, i) for i in range(5)], abs=1e-12)


@pytest.mark.parametrize("shape", [0.3, 1.0, 2.5, 40.0])
def test_gamma_columns_equal_the_drivers_draws(spark, shape):
    df = spark.range(3000).select("id", rng.gamma(shape, 0.5, "t", 1, F.col("id")).alias("x")).toPandas()
    assert df.x[:200].tolist() == pytest.approx([rng.gamma_value(shape, 0.5, "t", 1, i) for i in range(200)], rel=1e-9)
    assert df.x.min() > 0 and df.x.mean() == pytest.approx(0.5 * shape, rel=0.1) and df.x.var() == pytest.approx(0.25 * shape, rel=0.2)


def test_gamma_of_any_shape(spark):
    x = I.gamma_cells(spark, 500, 4, 2.5, 0.5, "g", 1).toPandas().x
    assert x.min() > 0 and abs(x.mean() - 1.25) < 0.08
    assert I.gamma_cells(spark, 500, 4, 2.5, 0.5, "g", 1).toPandas().x.tolist() == x.tolist()


# one row, around the session's 4 partitions, and around the 10,000 rows of an Arrow batch
@pytest.mark.parametrize("n", [1, 3, 4, 5, 9_999, 10_000, 10_001])
def test_segment_sum_and_normalize(spark, n):
    df = spark.range(1, n + 1).select(F.lit(5).alias("n"), F.col("id").cast("double").alias("x"))
    total = n * (n + 1) / 2
    assert R.segment_sum(df).first()["total"] == total
    got = R.segment_normalize(df, total="total").agg(F.sum("x"), F.max("x"), F.max("total")).first()
    assert tuple(got) == pytest.approx((1.0, n / total, total))


def test_matrix_and_sort(spark):
    m = R.matrix(spark, 1000, 20, lambda n, j: j + 1, blocks=12)
    assert m.rdd.getNumPartitions() == 12 and m.count() == 1000
    assert {tuple(r.row) for r in R.matrix_row(m, spark.createDataFrame([(3,), (999,)], "n long")).collect()} == {tuple(float(i) for i in range(1, 21))}
    x = spark.range(256).select((F.col("id") * 37 % 1024).alias("x"))
    assert [r.x for r in R.sort_values(x).collect()] == sorted(i * 37 % 1024 for i in range(256))
    assert R.sort_segments(x.withColumn("n", F.lit(1))).first()["sorted"] == sorted(i * 37 % 1024 for i in range(256))


def test_edge_list_file(spark, tmp_path):
    path = tmp_path / "graph.txt"
    path.write_text("# a\n# b\nnodes 5\nFrom To\n3\t1\n1 3\n2   2\nx 4\n4 -1\n\n  7 8 \n1 2 3\n5 6")  # no line end at the end
    assert rows(read_edge_list(spark, str(path))) == [(1, 3), (5, 6), (7, 8)]


def test_edge_list_header_of_a_file_in_many_blocks(spark, tmp_path):
    path = tmp_path / "graph.txt"
    path.write_text("1 2\n3 4\n5 6\n7 8\n" + "".join(f"{i} {i + 1}\n" for i in range(100, 6000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert rows(read_edge_list(spark, str(path))) == [(i, i + 1) for i in range(100, 6000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_dataset(spark, tmp_path):
    e = edges_of(spark, [(0, 1), (1, 2)])
    write_dataset(e, str(tmp_path / "d"), 3, 0.25)
    back, meta = read_dataset(spark, str(tmp_path / "d"))
    assert rows(back) == rows(e) and meta == {"n_vertices": 3, "heldout_ratio": 0.25, "n_edges": 2}


def test_config():
    assert Strategy.parse("nodelink") is Strategy.NODE_LINK and Strategy.parse(" BFNonLink") is Strategy.BF_NON_LINK
    with pytest.raises(ValueError, match="unknown strategy"):
        Strategy.parse("x")
    with pytest.raises(ValueError, match="ppx_interval"):
        Config(ppx_interval=0)
    c = Config(k=5, strategy=Strategy.BF, noise=Noise.ONE)
    assert Config.from_dict(c.to_dict()) == c and c.prior == 0.2 and "strategy: BF" in c.describe()


@pytest.mark.parametrize("prefetch", [False, True])
def test_resume_is_exact(spark, planted, tmp_path, prefetch):
    c = Config(k=4, mini_batch=16, neighbors=8, heldout_ratio=0.1, strategy=Strategy.NODE, seed=5, compact_every=2, prefetch=prefetch)
    one = Learner.from_edges(planted, c)
    one.heldout_perplexity()
    one.run(3)
    one.save(str(tmp_path / "c"))
    two = Learner.load(spark, str(tmp_path / "c"))
    one.run(2), two.run(2)
    assert one.theta == two.theta
    assert one.heldout_perplexity() == two.heldout_perplexity()
    assert rows(one.memberships()) == rows(two.memberships())
    assert one.memberships().count() == 100


def test_perplexity_falls_on_a_planted_partition(spark, planted):
    c = Config(k=4, mini_batch=64, neighbors=40, heldout_ratio=0.1, strategy=Strategy.NODE, seed=3, a=0.3, noise=Noise.GAUSSIAN)
    learner = Learner.from_edges(planted, c)
    first = learner.heldout_perplexity()
    learner.run(12)
    learner.evaluations, learner.ppx_state = 0, None
    assert learner.heldout_perplexity() < first
    assert {r.k for r in learner.strengths().collect()} == {0, 1, 2, 3}
    assert set(learner.stats()) >= {"sample", "phi", "pi", "theta", "perplexity"} and min(learner.stats().values()) > 0
    assert learner.training_perplexity() > 0
    assert metrics(spark, learner.history).count() == 2


def test_own_sampler(spark, planted):
    def first_edges(split, config, t):
        return S.Batch(split.train.orderBy("u", "v").limit(3), 1.0)

    learner = Learner.from_edges(planted, Config(k=2, neighbors=4, heldout_ratio=0.1), sampler=first_edges)
    assert learner.run(5, stop=lambda: learner.steps == 1) == 1


NAMES = ["vertex_ids", "split_counts", "training_ppx_set", "membership_flag", "sample_node", "neighbor_sample", "vector_functions", "theta_update", "running_perplexity", "train_3_steps"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_match_sql(spark, tiny, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    got = entry.queries()[name](spark, tiny).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    a, b = (x[key].sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_graphs_of_the_tables(spark, tiny):
    assert customer_supplier(spark, tiny).count() == 1444


def test_parts_with_numbers_beyond_the_first_supplier(spark, tmp_path):
    lines = pd.DataFrame({"l_partkey": [5, 5, 999999, 1000001, 1000007, 1000003, 1200000, None], "l_suppkey": [3, 3, 1, 1, 3, 7, 2, 4]}, dtype="Int64")
    spark.createDataFrame([tuple(None if pd.isna(x) else int(x) for x in r) for r in lines.itertuples(index=False)], "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    lineitem = lines  # noqa: F841 (the SQL names it)
    want = {tuple(None if pd.isna(x) else int(x) for x in r) for r in duckdb.sql(oracle_sql()["edges_part_supplier"]).fetchall()}
    got = [tuple(r) for r in part_supplier(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) == 7 and set(got) == want


def test_samplers_find_rare_vertices(spark):
    from quillmesh.operators import samplers
    from quillmesh.operators.split import Split

    n = 10**9  # draws never meet the few linked vertices
    train = spark.createDataFrame([(5, 900_000_001), (7, 8), (8, 9)], "u long, v long")
    split = Split(n, 3, train, spark.createDataFrame([], "u long, v long, y int"))
    config = Config(k=2, mini_batch=3)
    edges = {tuple(r) for r in train.collect()}
    assert {tuple(r) for r in samplers.bf_link(split, config, 1).edges.collect()} == edges
    one = {tuple(r) for r in samplers.node_link(split, config, 1).edges.collect()}
    assert one and one <= edges
    few = Split(5000, 3, train, split.heldout)
    seen = set(range(5000)) - {4321}
    assert samplers._unvisited(few, seen, "bf-non-link", config, 1, False) == 4321
    assert samplers._unvisited(few, seen | {4321}, "bf-non-link", config, 1, False) is None


def test_neighbors_on_the_driver_are_those_of_the_executors(spark):
    nodes = [0, 3, 17, 40]
    far = rows(S.neighbor_sample(spark.createDataFrame([(n,) for n in nodes], "n long"), 41, 30, 7, 5))
    assert sorted(S.neighbors_of_few(nodes, 41, 30, 7, 5)) == far


def test_edges_by_vertex(spark, planted):
    split = split_edges(planted, 100, 0.1, 3)
    lined = split.by_vertex()
    for some in ([5], [0, 17, 99], list(range(40))):
        assert rows(split.incident(some)) == rows(lined.incident(some))
    plan = lined.incident(list(range(40)))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(n" in plan.replace("\n", " ") or "In(n, [" in plan


@pytest.mark.parametrize(("pairs", "broadcast"), [(0, 500_000), (0, 0)])
def test_steps_of_large_batches_are_those_of_small_ones(spark, planted, monkeypatch, pairs, broadcast):
    """Pairs held by the driver, broadcast joins and shuffled joins give the same model."""
    from quillmesh.plans import learner as module

    config = Config(k=3, mini_batch=8, neighbors=6, heldout_ratio=0.1, strategy=Strategy.NODE_LINK, compact_every=2, prefetch=False)
    small = Learner.from_edges(planted, config)
    small.run(3)
    monkeypatch.setattr(module, "DRIVER_PAIRS", pairs)
    monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
    large = Learner.from_edges(planted, config)
    large.run(3)
    assert [x for t in large.theta for x in t] == pytest.approx([x for t in small.theta for x in t], rel=1e-9)
    a, b = (dict((r["n"], r["pi"]) for r in x.memberships().collect()) for x in (small, large))
    assert a.keys() == b.keys() and all(a[n] == pytest.approx(b[n], rel=1e-9) for n in a)
    assert large.heldout_perplexity() == pytest.approx(small.heldout_perplexity(), rel=1e-9)


def test_taken_partners_of_a_hub(spark):
    """A vertex with few free partners: the draws give way to a ranking."""
    n = 300
    train = spark.createDataFrame([(u, v) for u in range(40) for v in range(u + 1, n - 3)], "u long, v long")
    split = split_edges(train, n, 0.0, 1)
    config = Config(k=2, mini_batch=50)
    t = next(t for t in range(1, 200) if next(S._draws("node", config, t, n)) < 40)
    u = next(S._draws("node", config, t, n))
    got = rows(S.node_non_link(split, config, t).edges)
    assert got == sorted((u, v) for v in (297, 298, 299))
