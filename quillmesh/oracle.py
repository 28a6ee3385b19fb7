"""DuckDB SQL of the registered queries, written from the model's formulas, not from the Spark plans."""

from __future__ import annotations

import re

from .config import Config
from .operators.samplers import coin


def u(salt: str, *keys: object) -> str:
    args = ", ".join([f"'{salt}'", *map(str, keys)])
    return f"(('0x' || substr(md5(concat_ws(':', {args})), 1, 8))::bigint + 0.5::double) / 4294967296.0::double"


def z(salt: str, *keys: object) -> str:
    return f"sqrt(-2.0::double * ln({u(salt + '/r', *keys)})) * cos(2 * pi() * ({u(salt + '/a', *keys)}))"


# Each part names what it reads; a query gets only the parts it needs.
def parts(c: Config) -> dict[str, str]:
    s, e = c.seed, f"{c.epsilon!r}::double"
    nonlinks = lambda known, count, salt, seed: f"""
        SELECT u, v FROM (
          SELECT d.u, d.v, row_number() OVER (ORDER BY d.draw) AS k FROM (
            SELECT least(a, b) AS u, greatest(a, b) AS v, min(draw) AS draw FROM (
              SELECT i AS draw, floor(({u(salt + '/a', seed, 'i')}) * N)::bigint AS a, floor(({u(salt + '/b', seed, 'i')}) * N)::bigint AS b
              FROM (SELECT unnest(range((SELECT ({count}) * 12 + 3000 FROM sizes))) AS i), (SELECT n_vertices AS N FROM sizes)
            ) WHERE a <> b GROUP BY 1, 2
          ) d WHERE NOT EXISTS (SELECT 1 FROM {known} x WHERE x.u = d.u AND x.v = d.v)
        ) WHERE k <= (SELECT {count} FROM sizes)"""  # noqa: E731
    out = {
        "edges": "SELECT DISTINCT o_custkey::bigint AS u, 1000000 + l_suppkey::bigint AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
        "ids": "SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT u AS id FROM edges UNION SELECT v FROM edges)",
        "dense": "SELECT least(a.n, b.n) AS u, greatest(a.n, b.n) AS v FROM edges JOIN ids a ON a.id = edges.u JOIN ids b ON b.id = edges.v",
        "ends": "SELECT u AS n, v AS m FROM dense UNION ALL SELECT v, u FROM dense",
        "lined": f"SELECT u, v, row_number() OVER (ORDER BY {u('edge', s, 'u', 'v')}, u, v) - 1 AS pos FROM dense",
        "sizes": f"SELECT count(*) AS n_edges, count(*) - ceil((1::double - {c.heldout_ratio!r}::double / 2) * count(*))::bigint AS h, (SELECT count(*) FROM ids) AS n_vertices FROM dense",
        "train": "SELECT u, v FROM lined WHERE pos >= (SELECT h FROM sizes)",
        "links": "SELECT u, v FROM lined WHERE pos < (SELECT h FROM sizes)",
        "nonlinks": nonlinks("dense", "h", "non-link", s),
        "heldout": "SELECT u, v, 1 AS y FROM links UNION ALL SELECT u, v, 0 FROM nonlinks",
        "taken": "SELECT u, v FROM train UNION SELECT u, v FROM heldout",
        "pset": f"""
        SELECT u, v, 1 AS y FROM (SELECT u, v, row_number() OVER (ORDER BY {u('edge', s + 1, 'u', 'v')}, u, v) AS k FROM train)
        WHERE k <= floor({c.train_ppx_ratio!r}::double * (SELECT count(*) FROM train))
        UNION ALL SELECT u, v, 0 FROM pnon""",
        "pnon": nonlinks("taken", f"least(floor(floor({c.train_ppx_ratio!r}::double * (SELECT count(*) FROM train)) * (n_vertices * (n_vertices - 1) / 2) / n_edges)::bigint, (n_vertices * (n_vertices - 1) // 2 - (SELECT count(*) FROM taken))::bigint)", "train-non-link", s),
        "probes": "SELECT u, v FROM heldout UNION ALL SELECT v AS u, u AS v FROM train",
        "pairs": "SELECT p.u, p.v, (t.u IS NOT NULL)::bigint AS y FROM probes p LEFT JOIN train t ON t.u = least(p.u, p.v) AND t.v = greatest(p.u, p.v)",
        "cells": f"SELECT n, k, -ln({u('pi', s, 'n', 'k')}) AS x FROM (SELECT unnest(range((SELECT n_vertices FROM sizes))) AS n), (SELECT unnest(range({c.k})) AS k)",
        "pi0": "SELECT n, k, x / sum(x) OVER (PARTITION BY n) AS p, sum(x) OVER (PARTITION BY n) AS s FROM cells",
        "theta0": f"SELECT k, -ln({u('theta', s, 'k', 0)}) AS t0, -ln({u('theta', s, 'k', 1)}) AS t1 FROM (SELECT unnest(range({c.k})) AS k)",
        "seen0": "SELECT u, v, y, NULL::double AS q FROM heldout WHERE false",
    }
    like = lambda edges, pi, theta: f"""
        SELECT e.u, e.v, e.y, greatest(CASE WHEN e.y = 1 THEN sum(a.p * b.p * t.t1 / (t.t0 + t.t1))
          ELSE sum(a.p * b.p * (1 - t.t1 / (t.t0 + t.t1))) + (1 - sum(a.p * b.p)) * (1 - {e}) END, 1e-30::double) AS l
        FROM {edges} e JOIN {pi} a ON a.n = e.u JOIN {pi} b ON b.n = e.v AND b.k = a.k JOIN {theta} t ON t.k = a.k GROUP BY 1, 2, 3"""  # noqa: E731
    out["like0"], out["plike"] = like("heldout", "pi0", "theta0"), like("pset", "pi0", "theta0")
    for t in (1, 2, 3):
        o = t - 1
        eps = f"({c.a!r}::double * pow(1 + {t} / {c.b!r}::double, -{c.c!r}::double))"
        out |= {
            f"chosen{t}": f"SELECT n FROM (SELECT j, floor(({u('node-link', s, t, 'j')}) * (SELECT n_vertices FROM sizes))::bigint AS n FROM (SELECT unnest(range(4096)) AS j)) WHERE n IN (SELECT u FROM train UNION SELECT v FROM train) ORDER BY j LIMIT 1",
            f"batch{t}": f"SELECT u, v FROM train WHERE u = (SELECT n FROM chosen{t}) OR v = (SELECT n FROM chosen{t})",
            f"nodes{t}": f"SELECT u AS n FROM batch{t} UNION SELECT v FROM batch{t}",
            f"nb{t}": f"""
        SELECT n, m FROM (
          SELECT n, m, row_number() OVER (PARTITION BY n ORDER BY j) AS k FROM (
            SELECT n, m, min(j) AS j FROM (
              SELECT n, j, floor(({u('neighbor', s, t, 'n', 'j')}) * (SELECT n_vertices FROM sizes))::bigint AS m FROM nodes{t}, (SELECT unnest(range({4 * c.neighbors + 40})) AS j)
            ) WHERE n <> m GROUP BY 1, 2)) WHERE k <= {c.neighbors}""",
            f"terms{t}": f"""
        SELECT x.n, x.m, a.k, a.p AS pa, a.s, t.u IS NOT NULL AS y, a.p * (CASE WHEN t.u IS NOT NULL THEN b.p * (h.t1 / (h.t0 + h.t1) - {e}) + {e} ELSE b.p * ({e} - h.t1 / (h.t0 + h.t1)) + (1 - {e}) END) AS pr
        FROM nb{t} x JOIN pi{o} a ON a.n = x.n JOIN pi{o} b ON b.n = x.m AND b.k = a.k JOIN theta{o} h ON h.k = a.k
        LEFT JOIN train t ON t.u = least(x.n, x.m) AND t.v = greatest(x.n, x.m)""",
            f"grad{t}": f"SELECT n, k, sum(w / (pa * s) - 1 / s) AS g FROM (SELECT *, pr / sum(pr) OVER (PARTITION BY n, m) AS w FROM terms{t}) GROUP BY 1, 2",
            f"phi{t}": f"""
        SELECT n, k, greatest(abs(f + {eps} / 2 * ({c.prior!r}::double - f + (SELECT n_vertices FROM sizes) / {c.neighbors}::double * g) + sqrt({eps} * f) * ({z('phi-noise', s, t, 'n', 'k')})), 1e-24::double) AS phi
        FROM (SELECT g.n, g.k, g.g, a.p * a.s AS f FROM grad{t} g JOIN pi{o} a USING (n, k))""",
            f"new{t}": f"SELECT n, k, phi / sum(phi) OVER (PARTITION BY n) AS p, sum(phi) OVER (PARTITION BY n) AS s FROM phi{t}",
            f"pi{t}": f"SELECT o.n, o.k, coalesce(w.p, o.p) AS p, coalesce(w.s, o.s) AS s FROM pi{o} o LEFT JOIN new{t} w ON w.n = o.n AND w.k = o.k",
            f"bterms{t}": f"""
        SELECT e.u, e.v, a.k, (x.u IS NOT NULL)::int AS y, h.t0, h.t1, a.p * b.p AS f, a.p * b.p * (CASE WHEN x.u IS NOT NULL THEN h.t1 ELSE h.t0 END) / (h.t0 + h.t1) AS p
        FROM batch{t} e JOIN pi{t} a ON a.n = e.u JOIN pi{t} b ON b.n = e.v AND b.k = a.k JOIN theta{o} h ON h.k = a.k LEFT JOIN train x ON x.u = e.u AND x.v = e.v""",
            f"tgrad{t}": f"""
        SELECT k, sum(w * ((1 - y) / t0 - 1 / (t0 + t1))) AS g0, sum(w * (y / t1 - 1 / (t0 + t1))) AS g1 FROM (
          SELECT *, p / (sum(p) OVER (PARTITION BY u, v) + (CASE WHEN y = 1 THEN {e} ELSE 1 - {e} END) * (1 - sum(f) OVER (PARTITION BY u, v))) AS w FROM bterms{t}) GROUP BY 1""",
            f"theta{t}": "SELECT k, "
            + ", ".join(f"greatest(abs(h.t{i} + {eps} / 2 * ({eta!r}::double - h.t{i} + (SELECT n_vertices FROM sizes) * g.g{i}) + sqrt({eps} * h.t{i}) * ({z('theta-noise', s, t, 'k', i)})), 1e-24::double) AS t{i}" for i, eta in ((0, c.eta0), (1, c.eta1)))
            + f" FROM theta{o} h JOIN tgrad{t} g USING (k)",
        }
    out["like1"], out["like3"], out["after1"] = like("heldout", "pi1", "theta0"), like("heldout", "pi3", "theta3"), like("heldout", "pi1", "theta1")
    return out | searches(c, 1)


def searches(c: Config, t: int) -> dict[str, str]:
    """Breadth-first searches: one row for each level, with lists of what is taken and visited and of the next level's vertices."""
    s, m = c.seed, c.mini_batch
    draw = lambda salt: f"SELECT j, floor(({u(salt, s, t, 'j')}) * (SELECT n_vertices FROM sizes))::bigint AS n FROM (SELECT unnest(range(4096)) AS j)"
    lines = lambda salt, where: f"SELECT list(n ORDER BY j) AS l FROM (SELECT n, min(j) AS j FROM ({draw(salt)}) {where} GROUP BY n)"
    next_ones = lambda starts: f"""
        SELECT k, taken, visited, CASE WHEN len(frontier) > 0 THEN frontier ELSE [list_filter(l, lambda x: NOT list_contains(visited, x))[1]] END AS f
        FROM {{self}}, {starts} WHERE len(taken) < {m}"""  # noqa: E731
    search = lambda self, starts, rows, ends: f"""
        SELECT 0 AS k, []::STRUCT(u BIGINT, v BIGINT)[] AS taken, []::BIGINT[] AS visited, []::BIGINT[] AS frontier
        UNION ALL
        SELECT k + 1, list_concat(taken, list_transform(fresh, lambda x: struct_pack(u := x.u, v := x.v))), visited,
          list_sort(list_filter(list_distinct(flatten(list_transform(fresh, lambda x: {ends}))), lambda x: NOT list_contains(visited, x)))[1:{m}] FROM (
          SELECT k, taken, visited, list_filter(found, lambda x: NOT list_contains(taken, struct_pack(u := x.u, v := x.v)))[1:{m} - len(taken)] AS fresh FROM (
            SELECT k, taken, list_concat(visited, f) AS visited, {rows.format(step=next_ones(starts).format(self=self))} GROUP BY k, taken, visited, f))"""  # noqa: E731
    linked = f"list_sort(list(struct_pack(h := {u('bf-edge', s, t, 't.u', 't.v')}, u := t.u, v := t.v)))[1:{m}] AS found FROM ({{step}}) JOIN train t ON list_contains(f, t.u) OR list_contains(f, t.v)"
    free = f"""list_sort(list(struct_pack(h := {u('bf-order', s, t, 'd.n')}, j := d.j, u := u, v := v, m := d.m)))[1:{2 * m}] AS found FROM (
              SELECT k, taken, visited, f, u, v, min(struct_pack(n := n, j := j, m := m)) AS d FROM (
                SELECT *, least(n, m) AS u, greatest(n, m) AS v FROM (
                  SELECT *, floor(({u('bf-draw', s, t, 'n', 'j')}) * (SELECT n_vertices FROM sizes))::bigint AS m FROM (SELECT *, unnest(range(32)) AS j FROM (SELECT *, unnest(f) AS n FROM ({{step}}))))
                WHERE n <> m) x WHERE NOT EXISTS (SELECT 1 FROM known y WHERE y.u = x.u AND y.v = x.v)
              GROUP BY ALL)"""
    return {
        "known": "SELECT u, v FROM train UNION SELECT u, v FROM heldout",
        "linkedstarts": lines("bf-link", "WHERE n IN (SELECT u FROM train UNION SELECT v FROM train)"),
        "freestarts": lines("bf-non-link", ""),
        "bflink": search("bflink", "linkedstarts", linked, "[x.u, x.v]"),
        "bffree": search("bffree", "freestarts", free, "[x.m]"),
    }


def assemble(body: str, all_parts: dict[str, str]) -> str:
    """`body` after the parts that it needs, in order."""
    need: list[str] = []
    open_: set[str] = set()  # parts that read themselves

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[a-z]+[0-9]?\b", sql):
            if name in all_parts and name not in need and name not in open_:
                open_.add(name)
                visit(all_parts[name])
                need.append(name)

    visit(body)
    return (f"WITH{' RECURSIVE' * bool({'bflink', 'bffree'} & set(need))} " + ",\n".join(f"{n} AS MATERIALIZED ({all_parts[n]})" for n in need) + "\n" if need else "") + body


def all_sql(c: Config, step: int, digits: int) -> dict[str, str]:
    s = c.seed
    r = lambda x: f"round({x}, {digits}) + 0.0::double"
    ppx = lambda like: f"""SELECT n_link, n_nonlink, {r('ll_link')} AS ll_link, {r('ll_nonlink')} AS ll_nonlink, {r('exp(-(ll_link + ll_nonlink) / (n_link + n_nonlink))')} AS ppx FROM (
        SELECT count(*) FILTER (y = 1) AS n_link, count(*) FILTER (y = 0) AS n_nonlink, sum(ln(l)) FILTER (y = 1) AS ll_link, sum(ln(l)) FILTER (y = 0) AS ll_nonlink FROM {like})"""  # noqa: E731
    numbers = lambda n, x: f"SELECT i AS id, {x} AS x FROM (SELECT unnest(range({n})) AS i)"
    mean = lambda a, b: f"(SELECT a.u, a.v, a.y, (a.l + b.l) / 2 AS l FROM {a} a JOIN {b} b USING (u, v, y))"
    coin_link = coin(c, step)
    node_link = f"SELECT u, v, {r('(SELECT n_vertices FROM sizes)::double')} AS weight FROM batch1"
    free = f"""SELECT least(w, n) AS u, greatest(w, n) AS v, {r(f'2.0 * (SELECT n_edges FROM sizes) / {c.mini_batch}')} AS weight FROM (
        SELECT w, n, min(j) AS j FROM (
          SELECT j, floor(({u('non-link', s, step, 'j')}) * n_vertices)::bigint AS n, floor(({u('node', s, step, 0)}) * n_vertices)::bigint AS w FROM (SELECT unnest(range(4000)) AS j), sizes)
        WHERE n <> w AND NOT EXISTS (SELECT 1 FROM taken x WHERE x.u = least(w, n) AND x.v = greatest(w, n)) GROUP BY 1, 2
        ORDER BY j LIMIT {c.mini_batch})"""
    last = lambda x: f"(SELECT taken FROM {x} ORDER BY k DESC LIMIT 1)"
    taken = lambda x, weight: f"SELECT e.u AS u, e.v AS v, {r(weight)} AS weight FROM (SELECT unnest(taken) AS e FROM {last(x)})"
    bf_link = taken("bflink", f"(SELECT n_edges FROM sizes)::double / {c.mini_batch}")
    bf_free = taken("bffree", f"(SELECT n_vertices * (n_vertices - 1) / 2.0::double - n_edges FROM sizes) / {c.mini_batch}")
    fitted = f"SELECT 0::bigint AS step, * FROM ({ppx('like0')}) UNION ALL SELECT 1::bigint, * FROM ({ppx(mean('like0', 'after1'))})"
    d = 2.5 - 1 / 3
    settings = ", ".join(f"('{k}', '{'' if v is None else v}')" for k, v in c.to_dict().items())
    bodies = {
        "edges_canonical": "SELECT u, v FROM edges",
        "vertex_ids": "SELECT id, n FROM ids",
        "edges_dense": "SELECT u, v FROM dense",
        "edges_part_supplier": "SELECT DISTINCT l_partkey::bigint AS u, 1000000 + l_suppkey::bigint AS v FROM lineitem",
        "edges_co_ordered": "SELECT DISTINCT a.l_partkey::bigint AS u, b.l_partkey::bigint AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey",
        "degree": "SELECT n, count(*) AS degree FROM ends GROUP BY n",
        "max_fan_out": "SELECT max(d) AS max_fan_out FROM (SELECT count(*) AS d FROM ends GROUP BY n)",
        "adjacency": "SELECT n, string_agg(m::varchar, ',' ORDER BY m) AS neighbors FROM ends GROUP BY n",
        "neighbors_of": "SELECT n, m FROM ends",
        "random_edge": f"SELECT n, m FROM ends WHERE n = (SELECT n FROM (SELECT DISTINCT n FROM ends) ORDER BY {u('random-vertex', s, 0, 'n')}, n LIMIT 1) ORDER BY {u('random-neighbor', s, 0, 'm')}, m LIMIT 1",
        "edges_shuffled": "SELECT u, v, pos FROM lined",
        "split_counts": "SELECT (SELECT count(*) FROM train) AS n_train, (SELECT count(*) FROM links) AS n_heldout_links, (SELECT count(*) FROM nonlinks) AS n_heldout_nonlinks, (SELECT n_edges FROM sizes) AS n_edges",
        "split_train": "SELECT u, v FROM train",
        "heldout_links": "SELECT u, v FROM links",
        "heldout_nonlinks": "SELECT u, v FROM nonlinks",
        "training_ppx_set": "SELECT u, v, y::bigint AS y FROM pset",
        "membership_flag": "SELECT u, v, y FROM pairs",
        "membership_semi": "SELECT u, v FROM pairs WHERE y = 1",
        "membership_anti": "SELECT u, v FROM pairs WHERE y = 0",
        "sample_node_link": node_link,
        "sample_node_nonlink": free,
        "sample_node": node_link if coin_link else free,
        "sample_bf_link": bf_link,
        "sample_bf_nonlink": bf_free,
        "sample_bf": bf_link if coin_link else bf_free,
        "minibatch_nodes": "SELECT n FROM nodes1",
        "neighbor_sample": "SELECT n, m FROM nb1",
        "row_gather": f"SELECT n, k, {r('p')} AS p, {r('s')} AS phi_sum FROM pi0 WHERE n IN (SELECT n FROM nodes1)",
        "uniform_draws": numbers(1000, r(u("test", s, "i"))),
        "normal_draws": numbers(1000, r(z("test", s, "i"))),
        "integer_draws": numbers(1000, f"floor(({u('test', s, 'i')}) * 17)::bigint"),
        "gamma_init_general": f"""SELECT n, k, {r('0.5::double * arg_min(' + repr(d) + '::double * v, j)')} AS x FROM (
            SELECT *, pow(1 + x / sqrt(9 * {d!r}::double), 3) AS v FROM (
              SELECT n, k, j, {z('general/x', s, 'n', 'k', 'j')} AS x, {u('general/u', s, 'n', 'k', 'j')} AS a
              FROM (SELECT unnest(range(200)) AS n), (SELECT unnest(range(5)) AS k), (SELECT unnest(range(20)) AS j)))
            WHERE CASE WHEN v > 0 THEN ln(a) < 0.5 * x * x + {d!r}::double - {d!r}::double * v + {d!r}::double * ln(v) ELSE false END GROUP BY 1, 2""",
        "gamma_init": numbers(1000, r(f"-ln({u('test', s, 'i')})")),
        "pi_init": f"SELECT n, k, {r('p')} AS p, {r('s')} AS phi_sum FROM pi0",
        "theta_init": f"SELECT k, {r('t0')} AS t0, {r('t1')} AS t1 FROM theta0",
        "beta_normalize": f"SELECT k, {r('t0 / (t0 + t1)')} AS b0, {r('t1 / (t0 + t1)')} AS b1 FROM theta0",
        "theta_sum": f"SELECT k, {r('t0 + t1')} AS total FROM theta0",
        "segment_sum": f"SELECT l_suppkey::bigint AS n, {r('sum(l_quantity::double)')} AS total FROM lineitem GROUP BY 1",
        "segment_normalize": f"SELECT l_suppkey::bigint AS n, {r('1.0::double')} AS one, {r('max(l_quantity::double) / sum(l_quantity::double)')} AS top, {r('sum(l_quantity::double)')} AS total FROM lineitem GROUP BY 1",
        "sort_positions": "SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS pos, o_custkey::bigint AS x FROM orders",
        "sort_segments": "SELECT o_custkey::bigint AS n, string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey) AS sorted FROM orders GROUP BY 1",
        "strategy_parse": "SELECT * FROM (VALUES ('node', 'Node'), ('NODELINK', 'NodeLink'), (' NodeNonLink ', 'NodeNonLink'), ('bf', 'BF'), ('bflink', 'BFLink'), ('BFNONLINK', 'BFNonLink'), ('other', NULL)) t(text, strategy)",
        "config_settings": f"SELECT * FROM (VALUES {settings}) t(name, value)",
        "checkpoint_roundtrip": "SELECT 0.0::double AS max_difference, n_vertices::bigint AS n, 1.0::double AS same_theta FROM sizes",
        "checkpoint_refused": "SELECT 1::bigint AS refused",
        "fit_metrics": fitted,
        "command_line": fitted,
        "learner_stats": "SELECT * FROM (VALUES ('sample'), ('phi'), ('theta'), ('pi'), ('perplexity')) t(phase)",
        "unpack_edges": "SELECT u, v FROM dense",
        "sort_values": "SELECT o_custkey::bigint AS x FROM orders ORDER BY 1",
        "reduce_sums": f"SELECT {r('sum(l_quantity::double)')} AS q, {r('sum(l_suppkey::double)')} AS s FROM lineitem",
        "matrix_alloc": "SELECT i AS n, (i * 1100 + 55)::double AS total, 11::bigint AS cols FROM (SELECT unnest(range(90)) AS i)",
        "eps_schedule": f"SELECT i AS t, round({c.a!r}::double * pow(1 + i / {c.b!r}::double, -{c.c!r}::double), 12) AS eps FROM (SELECT unnest(range(1, 2001)) AS i)",
        "vector_functions": f"""SELECT i AS id, {r('sum(abs(a))')} AS abs_sum, {r('sum(greatest(a, b))')} AS max_sum, {r('sum(a * b)')} AS dot, {r('sum(sqrt(b) + 1)')} AS sqrt_sum, {r('sum(ln(b))')} AS log_sum, {r('sum(exp(a / 100))')} AS exp_sum, {r('sum((a - b) / b)')} AS rel,
            (least(i, 77) * 2147483648 + greatest(i, 77))::bigint AS packed FROM (SELECT i, i * (j + 1) / 7.0::double - 11 AS a, (i + j)::double AS b FROM (SELECT unnest(range(1, 200)) AS i), (SELECT unnest(range(4)) AS j)) GROUP BY i""",
        "phi_gradient": f"SELECT n, k, {r('g')} AS g FROM grad1",
        "phi_update": f"SELECT n, k, {r('phi')} AS phi FROM phi1",
        "pi_update": f"SELECT n, k, {r('p')} AS p, {r('s')} AS phi_sum FROM new1",
        "theta_gradient": f"SELECT k, {r('g0')} AS g0, {r('g1')} AS g1 FROM tgrad1",
        "theta_update": f"SELECT k, {r('t0')} AS t0, {r('t1')} AS t1 FROM theta1",
        "edge_likelihood": f"SELECT u, v, y::bigint AS y, {r('l')} AS l FROM like0",
        "heldout_perplexity": ppx("like0"),
        "training_perplexity": ppx("plike"),
        "running_perplexity": ppx(mean("like0", "like1")),
        "train_prefetched": f"SELECT p.ppx, p.ll_link, {r('t.t0')} AS t0, {r('t.t1')} AS t1 FROM ({ppx(mean('like0', 'like3'))}) p, (SELECT sum(t0) AS t0, sum(t1) AS t1 FROM theta3) t",
        "train_3_steps": f"SELECT p.ppx, p.ll_link, {r('t.t0')} AS t0, {r('t.t1')} AS t1 FROM ({ppx(mean('like0', 'like3'))}) p, (SELECT sum(t0) AS t0, sum(t1) AS t1 FROM theta3) t",
        "dataset_roundtrip": "SELECT u, v, (SELECT n_vertices FROM sizes) AS n_vertices FROM dense",
        "edge_list_file": "SELECT u, v FROM edges",
    }
    p = parts(c)
    return {name: assemble(body, p) for name, body in bodies.items()}
