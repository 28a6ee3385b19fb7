"""The golden micro-fixture: four vertices, two communities; expected values come from scalar loops over the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from quillmesh.config import Config, Noise
from quillmesh.operators import beta as B
from quillmesh.operators import evaluate as E
from quillmesh.operators import initial as I
from quillmesh.operators import phi as P

PI = {0: ([0.8, 0.2], 2.0), 1: ([0.6, 0.4], 1.5), 2: ([0.3, 0.7], 1.0), 3: ([0.5, 0.5], 3.0)}
THETA = [(1.0, 3.0), (2.0, 2.0)]
C = Config(k=2, neighbors=2, alpha=0.5, epsilon=1e-7, noise=Noise.ZERO)
close = lambda x: pytest.approx(x, abs=1e-9)


@pytest.fixture(scope="module")
def m(spark):
    pi = spark.createDataFrame([(n, p, s) for n, (p, s) in PI.items()], "n long, pi array<double>, phi_sum double")
    theta = I.theta_table(spark, THETA)
    train = spark.createDataFrame([(0, 1), (1, 2)], "u long, v long")
    held = spark.createDataFrame([(2, 3, 1), (0, 3, 0)], "u long, v long, y int")
    pairs = spark.createDataFrame([(0, 1), (0, 3), (1, 0), (1, 2)], "n long, m long")
    return {"pi": pi, "long": I.long_form(pi), "theta": theta, "beta": I.beta_normalize(theta), "train": train, "held": held, "pairs": pairs}


def table(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r[cols[0]], {})[r[cols[1]]] = r[cols[2]]
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def test_step_size():
    assert C.step_size(1) == close(0.031484630396742985)
    assert C.step_size(1000) == close(0.022405532913509107)


def test_gradient(m):
    g = table(P.phi_gradient(m["pairs"], m["long"], m["beta"], m["train"], C.epsilon), "n", "k", "g")
    assert g[0] == close([0.04326921741494194, -0.1730768696597681])
    assert g[1] == close([0.21212119804407348, -0.31818179706611])
    for n, row in g.items():  # an identity of the formulas
        assert sum(p * x for p, x in zip(PI[n][0], row)) == close(0.0)


@pytest.mark.parametrize(
    ("noise", "zero", "one"),
    [
        (Noise.ZERO, [1.5840457685996572, 0.3961249702483741], [0.9003816314403833, 0.588407932200565]),
        (Noise.ONE, [1.8084904358002587, 0.5083473038486749], [1.0687151318408343, 0.7258516597331294]),
    ],
)
def test_phi(m, noise, zero, one):
    g = P.phi_gradient(m["pairs"], m["long"], m["beta"], m["train"], C.epsilon)
    phi = table(P.phi_update(g, m["long"], 4, C.with_(noise=noise), 1), "n", "k", "phi")
    assert phi[0] == close(zero)
    assert phi[1] == close(one)


def new_pi(m):
    g = P.phi_gradient(m["pairs"], m["long"], m["beta"], m["train"], C.epsilon)
    return P.pi_update(P.phi_update(g, m["long"], 4, C, 1))


def test_pi(m):
    p = table(new_pi(m), "n", "k", "p")
    assert p[0] == close([0.799954134016332, 0.200045865983668])
    assert p[1] == close([0.6047742766536001, 0.3952257233464])


def gathered(m):
    flagged = m["pairs"].withColumn("y", F.expr("case when n = 0 and m = 3 then 0 else 1 end"))
    nb = flagged.join(m["pi"].select(F.col("n").alias("m"), F.col("pi").alias("pb")), "m").groupBy("n").agg(F.collect_list(F.struct("m", "y", "pb")).alias("nb"))
    return m["pi"].join(nb, "n")


@pytest.mark.parametrize("noise", list(Noise))
def test_arrow_form_equals_long_form(m, noise):
    c = C.with_(noise=noise)
    g = P.phi_gradient(m["pairs"], m["long"], m["beta"], m["train"], c.epsilon)
    long = table(P.pi_update(P.phi_update(g, m["long"], 4, c, 1)), "n", "k", "p")
    fast = {r["n"]: r["pi"] for r in P.arrow_step(gathered(m), I.beta_of(THETA), 4, c, 1).collect()}
    assert fast.keys() == long.keys()
    for n in fast:
        assert fast[n] == close(long[n])


def updated(m):
    new = new_pi(m).select("n", "k", F.col("p").alias("np"))
    return m["long"].join(new, ["n", "k"], "left").select("n", "k", F.coalesce("np", "p").alias("p"), "phi_sum")


GRADIENT = [[-0.11006156952171359, 0.03668718984057117], [-0.005326400772443337, 0.005326400772443337]]


def test_theta(m, spark):
    edges = spark.createDataFrame([(0, 1), (0, 3)], "u long, v long")
    g = B.theta_gradient(edges, updated(m), m["theta"], m["train"], C.epsilon)
    rows = {r["k"]: [r["g0"], r["g1"]] for r in g.collect()}
    for k in (0, 1):
        assert rows[k] == close(GRADIENT[k])
        assert THETA[k][0] * rows[k][0] + THETA[k][1] * rows[k][1] == close(0.0)
    new = {r["k"]: [r["t0"], r["t1"]] for r in B.theta_update(g, m["theta"], 4.0, C, 1).collect()}
    assert new[0] == close([0.9930695043254468, 2.970825534828108])
    assert new[1] == close([1.983922285282298, 1.9845930843209592])
    assert I.beta_of([new[0], new[1]]) == close([0.7494712916168674, 0.5000845151115955])
    assert B.theta_update_rows(THETA, [tuple(x) for x in GRADIENT], 4.0, C, 1)[0] == close(tuple(new[0]))


def test_theta_arrays(m, spark):
    long = {r["n"]: {} for r in updated(m).collect()}
    for r in updated(m).collect():
        long[r["n"]][r["k"]] = r["p"]
    row = lambda n: [long[n][0], long[n][1]]
    edges = spark.createDataFrame([(1, row(0), row(1)), (0, row(0), row(3))], "y int, pu array<double>, pv array<double>")
    for got, want in zip(B.theta_gradient_arrays(edges, THETA, C.epsilon), GRADIENT):
        assert list(got) == close(want)


def test_perplexity(m):
    first = E.running_mean(None, E.edge_likelihood(m["held"], m["long"], m["beta"], C.epsilon), 1).cache()
    q = {(r["u"], r["v"]): r["q"] for r in first.collect()}
    assert q[2, 3] == close(0.2875) and q[0, 3] == close(0.64999995)
    assert E.perplexity(E.perplexity_parts(first)).first()["ppx"] == close(2.313259816836494)
    theta = [(0.9930695043254468, 2.970825534828108), (1.983922285282298, 1.9845930843209592)]
    beta = I.beta_normalize(I.theta_table(m["pi"].sparkSession, theta))
    second = E.running_mean(first, E.edge_likelihood(m["held"], updated(m), beta, C.epsilon), 2)
    q = {(r["u"], r["v"]): r["q"] for r in second.collect()}
    assert q[2, 3] == close(0.28747513701579425) and q[0, 3] == close(0.6501043255135013)
    assert E.perplexity(E.perplexity_parts(second)).first()["ppx"] == close(2.3131741339501692)
    fast = {(r["u"], r["v"]): r["l"] for r in E.likelihood_arrays(m["held"], m["pi"], I.beta_of(THETA), C.epsilon).collect()}
    assert fast[2, 3] == close(0.2875) and fast[0, 3] == close(0.64999995)


def test_no_edges(m):
    empty = E.running_mean(None, E.edge_likelihood(m["held"].limit(0), m["long"], m["beta"], C.epsilon), 1)
    assert E.perplexity(E.perplexity_parts(empty)).first()["ppx"] == 1.0
    assert math.isclose(E.perplexity_value(0, 0.0), 1.0)
