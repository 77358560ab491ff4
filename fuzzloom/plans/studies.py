"""Registered queries of clusters, the bound check, sampled skip-gram, sweeps and kept models, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fuzzloom.functions import stats
from fuzzloom.operators import bounds, clusters, embedding, graph, infer, matrices, metrics, sampling, skipgram, split
from fuzzloom.plans import analyses, embedding_studies, states, sweep
from fuzzloom.plans.catalog import _doc_cells, _fitted, _tokens, query
from fuzzloom.plans.fixtures import FEATURES, SQL_DOCS, SQL_ORDERS, rules_docs, table
from fuzzloom.sources.staging import new_path, staged

CLUSTERS, LLOYD = 3, 14

_DRAW = "(CAST('0x' || substr(md5('0:{turn}:' || g || ':' || cell), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"


def _clusters_sql(group: str, k: int, rounds: int = LLOYD) -> str:
    """Starts by hashed draws and so many of Lloyd's steps, written out; more steps than are needed change nothing."""
    token = ", ".join(f"'{i}:' || coalesce({c}, 'null')" for i, c in enumerate(FEATURES))
    race = lambda turn, w, src: f"SELECT g, {turn} AS cluster, arg_min(t, -ln({_DRAW.format(turn=turn)}) / ({w})) AS t FROM {src} WHERE {w} > 0 GROUP BY g"
    parts = [
        f"WITH {SQL_DOCS}",
        "c AS (SELECT f0, f1, f2, f3, y, count(*) AS w, min(id) AS cell FROM rules GROUP BY ALL)",
        f"p AS (SELECT cell, y, w, {group} AS g, [{token}] AS t FROM c)",
        f"k0 AS ({race(0, 'w', 'p')})",
        "d0 AS (SELECT p.*, 2.0 * (4 - len(list_intersect(p.t, k0.t))) AS d FROM p JOIN k0 ON p.g = k0.g)",
    ]
    for i in range(1, k):
        parts.append(f"k{i} AS ({race(i, 'w * d', f'd{i - 1}')})")
        parts.append(f"d{i} AS (SELECT a.* REPLACE (CASE WHEN k.t IS NULL THEN 0.0 ELSE least(a.d, 2.0 * (4 - len(list_intersect(a.t, k.t)))) END AS d) FROM d{i - 1} a LEFT JOIN k{i} k ON a.g = k.g)")
    parts.append("m0 AS (" + " UNION ALL ".join(f"SELECT g, cluster, unnest(t) AS token, 1.0 AS x FROM k{i}" for i in range(k)) + ")")
    parts.append("e AS (SELECT cell, g, w, unnest(t) AS token FROM p)")
    for i in range(rounds):
        parts.append(f"""
    n{i} AS (SELECT g, cluster, sum(x * x) AS norm FROM m{i} GROUP BY ALL),
    s{i} AS (SELECT e.cell, e.g, m.cluster, sum(m.x) AS s FROM e JOIN m{i} m ON e.g = m.g AND e.token = m.token GROUP BY ALL),
    a{i} AS (SELECT p.cell, p.g, p.w, min({{'d': round(n.norm - 2 * coalesce(s.s, 0), 9), 'c': n.cluster}}).c AS cluster
             FROM p JOIN n{i} n ON p.g = n.g LEFT JOIN s{i} s ON s.cell = p.cell AND s.cluster = n.cluster GROUP BY p.cell, p.g, p.w),
    t{i} AS (SELECT g, cluster, sum(w) AS n FROM a{i} GROUP BY ALL),
    m{i + 1} AS (SELECT a.g, a.cluster, e.token, sum(a.w) / any_value(t.n) AS x
                 FROM a{i} a JOIN e ON e.cell = a.cell JOIN t{i} t ON t.g = a.g AND t.cluster = a.cluster GROUP BY a.g, a.cluster, e.token
                 UNION ALL SELECT m.* FROM m{i} m LEFT JOIN t{i} t ON t.g = m.g AND t.cluster = m.cluster WHERE t.n IS NULL)""")
    last = f"a{rounds - 1}"
    return ",\n".join(parts) + f"\nSELECT cell, CAST(dense_rank() OVER (PARTITION BY g ORDER BY cluster) - 1 AS INT) AS cluster FROM {last}"


@query(_clusters_sql("'g|' || y", CLUSTERS))
def clusters_by_label(spark, d):
    return clusters.clustered(_doc_cells(spark, d), FEATURES, CLUSTERS, ["y"]).select("cell", "cluster")


@query(_clusters_sql("'g'", 2 * CLUSTERS))
def clusters_global(spark, d):
    return clusters.clustered(_doc_cells(spark, d), FEATURES, 2 * CLUSTERS, []).select("cell", "cluster")


@query()
def cluster_select(spark, d):
    """A twentieth of the rules, chosen greedily within clusters over all labels."""
    r = staged(rules_docs(spark, d))
    return sampling.cluster_select(r, _doc_cells(spark, d), FEATURES, 0.05, CLUSTERS, within_label=False)


@query(f"""
WITH {SQL_DOCS},
plan AS (SELECT CAST(s * 20 + k AS INT) AS subset, n, CAST(greatest(1, round_even(ratio * n, 0)) AS INT) AS m
         FROM (VALUES (0, 10, 0.2), (1, 10, 0.4), (2, 14, 0.2), (3, 14, 0.4), (4, 18, 0.2), (5, 18, 0.4)) AS v(s, n, ratio), range(20) AS r(k)),
taken AS (SELECT subset, n, m, id, y, f0, f1, f2, f3 FROM rules, plan
          QUALIFY row_number() OVER (PARTITION BY subset ORDER BY md5('0:' || subset || ':' || id), id) <= n),
held AS (SELECT *, CAST(row_number() OVER (PARTITION BY subset ORDER BY id) - 1 AS INT) AS pos, count(*) OVER (PARTITION BY subset) AS have FROM taken),
pair AS (SELECT l.subset, l.pos, r.pos AS other, (l.f0 = r.f0)::INT + (l.f1 = r.f1)::INT + (l.f2 = r.f2)::INT + (l.f3 = r.f3)::INT AS k
         FROM held l JOIN held r ON l.subset = r.subset AND l.y = r.y),
mask AS (SELECT subset, pos, v, CAST(sum(1 << other) AS BIGINT) AS bits FROM pair, range(1, 5) AS x(v) WHERE k >= v GROUP BY ALL),
sets AS (SELECT subset, list(bits) AS masks FROM mask GROUP BY subset),
size AS (SELECT subset, any_value(have) AS n, least(any_value(m), any_value(have)) AS m FROM held GROUP BY subset),
choice AS (SELECT size.subset, size.n, size.m, s AS bits FROM size, range(262144) AS r(s) WHERE s < (1 << size.n) AND bit_count(s::BIGINT) = size.m),
scored AS (SELECT c.subset, c.n, c.m, len(list_filter(masks, lambda x: (x & c.bits) <> 0)) AS covered FROM choice c JOIN sets USING (subset))
SELECT subset, CAST(n AS INT) AS n, CAST(m AS INT) AS m, CAST(max(covered) AS BIGINT) AS best FROM scored GROUP BY ALL
""")
def bound_optima(spark, d):
    """The exact optimum of 120 subsets of rules."""
    held = staged(bounds.subsets(rules_docs(spark, d), bounds.SIZES, bounds.RATIOS, bounds.REPEATS))
    whole = held.select("subset", F.lit("all").alias("part"), "pos", F.col("m").alias("budget"))
    size = held.select("subset", "n", "m").distinct()
    return bounds.solved(bounds.instances(whole, bounds.reach(held, FEATURES))).join(size, "subset").select("subset", "n", "m", "best")



def _checked(spark, d):
    return bounds.bound_check(rules_docs(spark, d), FEATURES)


@query()
def bound_check(spark, d):
    return _checked(spark, d)


@query()
def bound_violations(spark, d):
    return bounds.violations(_checked(spark, d))


@query()
def skip_gram(spark, d):
    """Vectors of the orders' levels from walks over their graph."""
    walks = graph.random_walks(graph.edge_weights(_tokens(spark, d)), 3, 8)
    return skipgram.skip_gram(walks, dim=8, epochs=3, rate=0.001)


@query(f"""
WITH {SQL_ORDERS}, c AS (SELECT f0, f1, f2, f3, y, count(*) AS w, min(id) AS cell FROM rules GROUP BY ALL),
t AS ({" UNION ALL ".join(f"SELECT cell, '{c}-' || {c} AS token FROM c" for c in FEATURES)}),
e AS (SELECT DISTINCT a.token AS u, b.token AS v FROM t a JOIN t b ON a.cell = b.cell AND a.token <> b.token),
nx AS (SELECT u, list(v ORDER BY v) AS next FROM e GROUP BY u),
w0 AS (SELECT CAST(walk AS INT) AS walk, u AS start, [u] AS path FROM nx, range(1, 4) AS r(walk)),
w1 AS (SELECT walk, start, list_append(path, next[CAST('0x' || substr(md5('0:' || walk || ':' || start || ':0'), 1, 8) AS BIGINT) % len(next) + 1]) AS path FROM w0 JOIN nx ON nx.u = path[-1]),
w2 AS (SELECT walk, start, list_append(path, next[CAST('0x' || substr(md5('0:' || walk || ':' || start || ':1'), 1, 8) AS BIGINT) % len(next) + 1]) AS path FROM w1 JOIN nx ON nx.u = path[-1]),
p AS (SELECT path[i] AS u, path[j] AS v FROM w2, range(1, 4) AS a(i), range(1, 4) AS b(j) WHERE i <> j)
SELECT u, v, count(*) AS n FROM p GROUP BY ALL
""")
def walk_pairs(spark, d):
    """How often two tokens meet in a window of two, over walks of three tokens."""
    walks = graph.random_walks(graph.edge_weights(_tokens(spark, d)), 3, 3)
    return skipgram.walk_pairs(walks, 2).groupBy("u", "v").agg(F.count("*").alias("n"))


@query()
def bootstrap_price(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("v"))
    return stats.bootstrap_ci(o, rounds=500)


@query("""
WITH g AS (SELECT CAST(s_nationkey + 1 AS DOUBLE) AS n, CAST(sum(s_acctbal) AS DOUBLE) AS s FROM supplier GROUP BY 1),
f AS (SELECT regr_slope(ln(s), ln(n)) AS a, regr_intercept(ln(s), ln(n)) AS b FROM g WHERE s > 0)
SELECT n, round(exp(b + a * ln(n)), 4) AS s FROM f, (VALUES (100.0::DOUBLE), (1000.0::DOUBLE)) AS v(n)
""")
def power_extrapolated(spark, d):
    g = table(spark, d, "supplier").groupBy((F.col("s_nationkey") + 1).cast("double").alias("n")).agg(F.sum("s_acctbal").cast("double").alias("s"))
    return stats.extrapolated(g, [100.0, 1000.0]).withColumn("s", F.round("s", 4))


@query()
def sweep_thresholds(spark, d):
    """Accuracy on the fifth fold under several seeds and shares of rules; the second sweep finds all but one kept."""
    rules, path = staged(rules_docs(spark, d)), new_path(spark)

    def train(r, seed, share):
        folded = staged(split.stratified_folds(r, seed=seed))
        own = folded.filter("fold <> 0")
        cs = staged(matrices.cells(split.random_sample(own, max(1, int(share * own.count()))), FEATURES))
        scored = infer.node_scores(folded.filter("fold = 0"), matrices.node_table(cs, FEATURES), FEATURES).withColumns({k: F.coalesce(k, F.lit(0)) for k in ("d0", "d1")})
        pred = scored.withColumn("pred", (F.col("d1") > F.col("d0")).cast("int"))
        return metrics.confusion(pred).select("accuracy").first().asDict()

    ask = lambda shares: sweep.sweep(spark, path, "thresholds", {"docs": rules}, [{"seed": s, "share": x} for s in (42, 43) for x in shares], train, {"seed": 42, "share": 1.0})
    ask((1.0,))
    return ask((1.0, 0.5)).select("input", "settings", F.col("metrics")["accuracy"].alias("accuracy"))


@query()
def model_restored(spark, d):
    """Decisions of a model that was kept and restored."""
    model, asked = _fitted(spark, d)
    path = new_path(spark)
    states.save(spark, path, model)
    return embedding.predict(asked, states.load(spark, path))


def _folded_orders(spark, d):
    """Orders in five folds, with their total price, the customer's balance and the clerk's number."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    raw = staged(o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_totalprice").cast("double").alias("price"), F.col("c_acctbal").cast("double").alias("balance"), (F.col("o_custkey") % 100).cast("double").alias("number")))
    return staged(split.stratified_folds(raw))


_ORDER_LEVELS = {"price": "f0", "balance": "f1", "number": "f2"}


@query()
def ablation(spark, d):
    """Mean areas under the curve by way to impute, scope, score and sample, over five folds; 0 is a missing number."""
    return analyses.ablation(_folded_orders(spark, d), _ORDER_LEVELS, 0.1, zero_missing=("number",))


@query()
def factor_effects(spark, d):
    """The effect of each switch of the ablation."""
    rows = analyses.factorial(_folded_orders(spark, d), _ORDER_LEVELS, 0.1, scopes=("upper", "global"), zero_missing=("number",))
    return analyses.effects(rows, ["method", "impute", "scope", "score"])


@query()
def scope_sensitivity(spark, d):
    """Areas under the curve and balanced accuracy of three pair scopes, for all rules and three samples of them."""
    return analyses.scope_sensitivity(_folded_orders(spark, d), _ORDER_LEVELS, 0.1, clusters=3)


_FOLD_OF = "(row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 5"


@query(f"""
WITH raw AS (SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INT) AS y, CAST(o_totalprice AS DOUBLE) AS price, CAST(c_acctbal AS DOUBLE) AS balance,
                    nullif(CAST(o_custkey % 100 AS DOUBLE), 0) AS number FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT *, CAST({_FOLD_OF} AS INT) AS own FROM raw),
x AS (SELECT v.fold, w.impute, f.*, CASE WHEN own = fold THEN 'test' ELSE 'train' END AS part, CASE WHEN impute = 'class' THEN y ELSE -1 END AS grp
      FROM f, range(5) AS v(fold), (VALUES ('global'), ('class')) AS w(impute)),
m AS (SELECT fold, impute, grp, median(number) AS v FROM x WHERE part = 'train' GROUP BY ALL),
i AS (SELECT x.* REPLACE (coalesce(x.number, m.v) AS number) FROM x JOIN m ON x.fold = m.fold AND x.impute = m.impute AND x.grp = m.grp),
q AS (SELECT fold, impute, quantile_cont(price, [1.0/3, 2.0/3]) AS a, quantile_cont(balance, [1.0/3, 2.0/3]) AS b, quantile_cont(number, [1.0/3, 2.0/3]) AS c FROM i WHERE part = 'train' GROUP BY ALL)
SELECT CAST(i.fold AS INT) AS fold, i.impute, part, y,
       {", ".join(f"CASE WHEN {v} <= q.{k}[1] THEN 'Low' WHEN {v} <= q.{k}[2] THEN 'Medium' ELSE 'High' END AS {n}" for v, k, n in (("price", "a", "f0"), ("balance", "b", "f1"), ("number", "c", "f2")))},
       count(*) AS n
FROM i JOIN q ON i.fold = q.fold AND i.impute = q.impute GROUP BY ALL
""")
def factorial_cells(spark, d):
    """Rows by levels, of each fold and way to impute, all in one plan."""
    counted, _ = analyses.counted_settings(_folded_orders(spark, d), _ORDER_LEVELS, zero_missing=("number",))
    level = [F.element_at(F.split(c, r"\|"), -1).alias(c) for c in _ORDER_LEVELS.values()]
    return counted.select("fold", "impute", "part", "y", *level, "n")


@query()
def embedding_study(spark, d):
    """Metrics of two sizes of the embedding, trained for two steps on each half of the documents' rules and asked the other."""
    folded = staged(split.stratified_folds(rules_docs(spark, d), k=2))
    halves = {f"half {k}": folded.withColumn("part", F.when(F.col("fold") == k, "test").otherwise("train")).drop("fold") for k in (0, 1)}
    return embedding_studies.study(spark, new_path(spark), halves, FEATURES, embedding_studies.by_dims((4, 8)), defaults={"steps": 2}).filter("metric NOT IN ('ms', 'train_s')")  # times differ from run to run
