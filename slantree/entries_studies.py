"""Queries of the studies: pairs across trees, budgets, cones, descent, proxies; and small relational pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slantree.entries import COLS, M, REC, V, base, missing, query, r, records
from slantree.functions import analysis, studies
from slantree.operators import ordered, prepare, splits

DEG = "degrees(acos(least(1.0, abs({a}[1]*{b}[1]+{a}[2]*{b}[2]+{a}[3]*{b}[3]) / ({na}*{nb}))))"


@query(REC + f", d as (select *, floor(('0x' || substr(md5('pair' || tree_id || '-' || node_id),1,8))::bigint / 4294967296.0::double * (select count(*) from rec)) as bucket from n), s as (select * from d where bucket < least((select count(*) from rec), 2 * 2000)), p as (select {DEG.format(a='a.w', b='b.w', na='a.nw', nb='b.nw')} as deg from s a join s b on a.bucket = b.bucket and a.tree_id < b.tree_id) select count(*) as n, round(avg(deg), 5) as mean_deg from p")
def cross_tree_angle(spark, sf):
    """Mean angle of a hash sample of pairs of splits of different trees."""
    return studies.cross_tree_pairs(records(spark, sf), 2000).agg(F.count("*").alias("n"), r(F.avg("deg"), 5).alias("mean_deg"))


@query(REC + ", j as (select p.*, n.family, n.gain from pair p join n using (tree_id, node_id)), s as (select depth, family, avg(deg) as drift_deg, count(*) as n, sum(gain) as g from j group by all) select depth, family, round(drift_deg,5) as drift_deg, n, round(n / sum(n) over (partition by depth),6) as win_share, round(g / sum(g) over (partition by depth),6) as gain_share from s")
def drift_by_winner(spark, sf):
    d = studies.drift_by_family(records(spark, sf))
    return d.select("depth", "family", r("drift_deg", 5).alias("drift_deg"), "n", r("win_share").alias("win_share"), r("gain_share").alias("gain_share"))


#: Candidate gains: orders are nodes' groups of 40, return flags are families.
GAINS = "gains as (select (l_orderkey // 40)::bigint as node, l_returnflag as family, l_extendedprice::double as gain from lineitem)"
BUDGET_STEPS = (1, 2, 4, 8, 16, 32)


def candidate_gains(spark, sf) -> DataFrame:
    """A row per lineitem row; nodes are dealt into as many parts as the rows ask for."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    gains = li.select(F.expr("l_orderkey div 40").alias("node"), F.col("l_returnflag").alias("family"), F.col("l_extendedprice").cast("double").alias("gain"))
    return gains.repartition(ordered.parts_for(li), "node")


@query("with " + GAINS + f", q as (select *, max(gain) over (partition by node) as top, count(*) over (partition by node, family) as n, row_number() over (partition by node, family order by gain) as i from gains), e as (select node, family, k, sum(gain / top * (power(i/n, k) - power((i-1)/n, k))) as v from q, (select unnest({list(BUDGET_STEPS)}) as k) where n >= 3 and top > 0 group by all) select family, k, round(avg(v), 6) as value, count(*) as n from e group by family, k")
def marginal_value_curves(spark, sf):
    """E[largest of k draws] of each family over the node's best, for all k at once."""
    return studies.marginal_curves(candidate_gains(spark, sf), BUDGET_STEPS).withColumn("value", r("value"))


@query()
def greedy_family_budget(spark, sf):
    """Draws of a budget of 12, given one by one to the family that helps most; held against brute force in the tests."""
    spent, mean = studies.greedy_budget(candidate_gains(spark, sf), 12)
    return spark.createDataFrame([(f, n, round(mean, 6)) for f, n in sorted(spent.items())], "family string, draws int, value double")


OFFSETS = [[1.0, 0.5, -0.3], [-0.2, 1.0, 0.4]]
PARENTS = {"A": [0.6, 0.8, 0.0], "N": [0.0, 0.6, -0.8], "R": [1.0, 0.0, 0.0]}
DEPTHS = {"A": 1, "N": 1, "R": 2}
SCALED = ["(x0 - 25.5) / 49", "(x1 - 0.05) / 0.1", "(x2 - 0.04) / 0.08"]


def scaled_rows(spark, sf) -> DataFrame:
    b = base(spark, sf)
    return b.select(F.col("cat").alias("node"), *[F.expr(e).cast("double").alias(f"z{k}") for k, e in enumerate(SCALED)], (F.lit(0.5) - F.col("y")).alias("g0"), F.lit(0.25).alias("h0"))


Z = V + ", z as (select cat as node, " + ", ".join(f"{e.replace('25.5', '25.5::double').replace('49', '49.0::double').replace('0.05', '0.05::double').replace('0.1', '0.1::double').replace('0.04', '0.04::double').replace('0.08', '0.08::double')} as z{k}" for k, e in enumerate(SCALED)) + ", 0.5::double - y as g0, 0.25::double as h0 from v)"


def _cone_sql() -> str:
    values = ", ".join(f"('{n}', {DEPTHS[n]}, {p[0]}::double, {p[1]}::double, {p[2]}::double, {k}, {o[0]}::double, {o[1]}::double, {o[2]}::double)" for n, p in PARENTS.items() for k, o in enumerate(OFFSETS))
    r_ = [f"r{i} / sqrt(r0*r0 + r1*r1 + r2*r2)" for i in range(3)]
    return Z + f""", c0 as (select node, depth, p0, p1, p2, k, {', '.join(f'{e} as r{i}' for i, e in enumerate(r_))} from (values {values}) t(node, depth, p0, p1, p2, k, r0, r1, r2)),
c1 as (select node, depth, k, 'near' as cone, {', '.join(f'p{i} + 0.2::double * r{i} as w{i}' for i in range(3))} from c0
 union all select node, depth, k, 'orth', {', '.join(f'r{i} - p{i} * (r0*p0 + r1*p1 + r2*p2)' for i in range(3))} from c0 union all select node, depth, k, 'rand', r0, r1, r2 from c0),
pr as (select c1.node, depth, cone, k, (w0*z0 + w1*z1 + w2*z2) / sqrt(w0*w0 + w1*w1 + w2*w2) as p, g0 from z join c1 using (node)),
rg as (select node, cone, k, min(p) as lo, max(p) as hi from pr group by all),
h as (select node, depth, cone, k, least(63, floor((p - lo) / (hi - lo + 1e-8::double) * 64))::int as bin, sum(g0) as g, count(*) as n from pr join rg using (node, cone, k) group by all),
s as (select *, sum(g) over w as lg, sum(n) over w as ln, sum(g) over q as tg, sum(n) over q as tn from h window w as (partition by node, cone, k order by bin), q as (partition by node, cone, k)),
b as (select node, depth, cone, max(0.5 * (lg*lg/(0.25*ln+1+1e-8::double) + (tg-lg)*(tg-lg)/(0.25*(tn-ln)+1+1e-8::double) - tg*tg/(0.25*tn+1+1e-8::double))) as gain from s where ln >= 1 and tn - ln >= 1 group by all),
x as (select node, depth, max(gain) filter (cone = 'near') as near, max(gain) filter (cone = 'orth') as orth, max(gain) filter (cone = 'rand') as rand from b group by all)
select depth, round(avg(near), 3) as near, round(avg(orth), 3) as orth, round(avg(rand), 3) as rand, round(avg((orth > near)::int), 6) as orth_wins, count(*) as n, round(avg(orth) / (avg(near) + 1e-12), 5) as orth_over_near from x group by depth"""


@query(_cone_sql())
def cone_probe(spark, sf):
    """The best gain near a parent's direction, orthogonal to it and anywhere, by depth."""
    parents = spark.createDataFrame(list(PARENTS.items()), "node string, w array<double>")
    depths = spark.createDataFrame(list(DEPTHS.items()), "node string, depth int")
    gains = studies.cone_gains(scaled_rows(spark, sf), ["z0", "z1", "z2"], studies.cone_directions(parents, OFFSETS))
    s = studies.cone_summary(gains, depths)
    return s.select("depth", *[r(c, 3).alias(c) for c in ("near", "orth", "rand")], r("orth_wins").alias("orth_wins"), "n", r("orth_over_near", 5).alias("orth_over_near"))


def _descent_sql(passes: int = 3) -> str:
    pairs = [(i, j) for i in range(3) for j in range(3)]
    sql = Z + ", a as (select node, " + ", ".join(f"sum(h0*z{i}*z{j}){' + 1' if i == j else ''} as a{i}{j}" for i, j in pairs) + ", " + ", ".join(f"sum(z{i}*g0) as g{i}" for i in range(3)) + " from z group by node)"
    sql += ", w0_ as (select *, " + ", ".join(f"-g{i} / sqrt(g0*g0+g1*g1+g2*g2) as w{i}" for i in range(3)) + " from a)"

    def j(w):
        return "power(" + " + ".join(f"{w[i]}*g{i}" for i in range(3)) + ", 2) / (" + " + ".join(f"{w[i]}*{w[k]}*a{i}{k}" for i, k in pairs) + ")"

    w, at = ["w0", "w1", "w2"], 0
    sql += f", v0_ as (select *, {j(w)} as j_before from w0_)"
    last = "v0_"
    for step in range(passes * 3):
        f = step % 3
        sql += f""", s{step} as (select *, w0*g0 + w1*g1 + w2*g2 as aa, {' + '.join(f'w{i}*a{f}{i}' for i in range(3))} as cc, {' + '.join(f'w{i}*w{k}*a{i}{k}' for i, k in pairs)} as bb from {last}),
t{step} as (select *, case when abs(g{f}*cc - aa*a{f}{f}) > 1e-9 then greatest(-10.0, least(10.0, (aa*cc - g{f}*bb) / (g{f}*cc - aa*a{f}{f}))) else 0.0 end as dd from s{step}),
u{step} as (select * exclude (aa, bb, cc, dd, w{f}), case when {j([f'(w{i} + dd)' if i == f else f'w{i}' for i in range(3)])} >= {j(w)} then w{f} + dd else w{f} end as w{f} from t{step})"""
        last = f"u{step}"
    return sql + f" select node, round(j_before, 3) as j_before, round({j(w)}, 3) as j_after from {last}"


@query(_descent_sql())
def coordinate_descent(spark, sf):
    """J(w) of the covariance direction before and after three passes, per node."""
    d = studies.descent(studies.grams(scaled_rows(spark, sf), ["z0", "z1", "z2"], "g0", "h0"))
    return d.select("node", r("j_before", 3).alias("j_before"), r("j_after", 3).alias("j_after"))


@query(REC + " select depth, round(median(abs(w[1])/30/gain),6) as median_ratio from rec where gain > 0 group by depth")
def fidelity_median_by_depth(spark, sf):
    rec = records(spark, sf).withColumn("proxy", F.abs(F.col("w")[0]) / 30)
    return studies.fidelity_median(rec, "proxy").withColumn("median_ratio", r("median_ratio"))


PROBES = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.6, 0.8, 0.0], [0.6, 0.0, -0.8], [0.2, 0.9, -0.4], [0.5, 0.5, 0.7], [-0.3, 0.9, 0.3]]


def _proxy_sql() -> str:
    values = ", ".join(f"({k}, {', '.join(f'{v}::double' for v in w)})" for k, w in enumerate(PROBES))
    return Z + f""", d as (select * from (values {values}) t(dir, w0, w1, w2)), p as (select dir, w0*z0 + w1*z1 + w2*z2 as p, g0 from z, d),
l as (select dir, power(sum(p*g0), 2) / (sum(0.25*p*p) + 1) as linear from p group by dir),
c as (select -sum(z0*g0) as c0, -sum(z1*g0) as c1, -sum(z2*g0) as c2 from z),
k as (select dir, abs(w0*c0 + w1*c1 + w2*c2) / (sqrt(w0*w0+w1*w1+w2*w2) * sqrt(c0*c0+c1*c1+c2*c2)) as cosine from d, c),
rg as (select dir, min(p) as lo, max(p) as hi from p group by dir),
h as (select dir, least(63, floor((p - lo) / (hi - lo + 1e-8::double) * 64))::int as bin, sum(g0) as g, count(*) as n from p join rg using (dir) group by all),
s as (select *, sum(g) over w as lg, sum(n) over w as ln, sum(g) over q as tg, sum(n) over q as tn from h window w as (partition by dir order by bin), q as (partition by dir)),
b as (select dir, max(0.5 * (lg*lg/(0.25*ln+1+1e-8::double) + (tg-lg)*(tg-lg)/(0.25*(tn-ln)+1+1e-8::double) - tg*tg/(0.25*tn+1+1e-8::double))) as gain from s where ln >= 1 and tn - ln >= 1 group by dir)
select round(corr(linear, gain), 5) as linear_corr, round(corr(cosine, gain), 5) as cosine_corr, count(*) as n from l join k using (dir) join b using (dir)"""


@query(_proxy_sql())
def proxy_correlation(spark, sf):
    """How well cheap proxies rank directions: their correlation with the true gain."""
    p = studies.proxies(scaled_rows(spark, sf).drop("node"), PROBES, ["z0", "z1", "z2"])
    return p.agg(r(F.corr("linear", "gain"), 5).alias("linear_corr"), r(F.corr("cosine", "gain"), 5).alias("cosine_corr"), F.count("*").alias("n"))


# --- relational pieces -------------------------------------------------------------------------------


@query("select l_linestatus, count(*) as n from lineitem where l_returnflag in ('A', 'R') group by 1")
def membership_filter(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.where(F.col("l_returnflag").isin("A", "R")).groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query(REC + ", e as (select gain, list_sum(list_transform(w, lambda x: abs(x))) as size, unnest([0,1,2]) as f, unnest(w) as v from rec), s as (select f, sum(abs(v)/size*gain) as g from e where v <> 0 group by f) select f, row_number() over (order by g desc, f)::int as place from s")
def importance_order(spark, sf):
    """Features by importance, the largest first, ties by name."""
    i = analysis.importance(records(spark, sf))
    return i.select("f", F.row_number().over(W.orderBy(F.desc("by_gain"), "f")).alias("place"))  # a row per feature


@query(REC + " select depth, family, round(avg(gain), 5) as mean_gain, row_number() over (order by avg(gain), depth, family)::int as place from rec group by depth, family")
def gains_in_plot_order(spark, sf):
    """A summary sorted by value, as a plot wants it."""
    g = records(spark, sf).groupBy("depth", "family").agg(F.avg("gain").alias("mean_gain"))
    return g.select("depth", "family", r("mean_gain", 5).alias("mean_gain"), F.row_number().over(W.orderBy("mean_gain", "depth", "family")).alias("place"))  # a row per depth and family


@query(Z + ", s as (" + " union all ".join(f"select node, {i} as f, abs(sum(z{i}*g0)) / sqrt(sum(0.25*z{i}*z{i}) + 1 + 1e-8) as sis from z group by node" for i in range(3)) + ") select node, f, round(sis, 5) as sis from s qualify row_number() over (partition by node order by sis desc, f) <= 2")
def top_features_by_node(spark, sf):
    """The two best-scored features of each node, from all its rows."""
    s = splits.sis_scores(scaled_rows(spark, sf), ["z0", "z1", "z2"], "g0", "h0")
    own = W.partitionBy("node").orderBy(F.desc("sis"), "f")  # as many rows as features
    return s.withColumn("k", F.row_number().over(own)).where("k <= 2").select("node", "f", r("sis", 5).alias("sis"))


@query(M + ", s as (" + " union all ".join(f"select sum({c}) / (count({c}) + 1e-8) as v from m" for c in COLS[:1]) + ") select x0_missing, count(*) as n, round(sum(coalesce(x0, v)), 3) as total from (select *, x0 is null as x0_missing from m), s group by 1")
def impute_statistic_mean(spark, sf):
    """Missing values become the mean that the statistics give, sum / (n + eps)."""
    m = missing(spark, sf)
    mean = prepare.column_stats(m, ["x0"]).first()["mean"]
    return prepare.impute(m, ["x0"], {"x0": mean}).groupBy("x0_missing").agg(F.count("*").alias("n"), r(F.sum("x0"), 3).alias("total"))


@query("select replace(lower(trim(p_type)), ' ', '_') as name, upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) as brand, count(*) as n from part group by all")
def tidy_names(spark, sf):
    """Names trimmed, lower-cased and joined, and first letters raised: how column and dataset names are made."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.groupBy(F.replace(F.lower(F.trim("p_type")), F.lit(" "), F.lit("_")).alias("name"), F.initcap(F.lower("p_brand")).alias("brand")).agg(F.count("*").alias("n"))


@query("with n as (select l_orderkey as node from lineitem group by 1), p as (select node, f from n, range(6) b(f)), u as (select *, ('0x' || substr(md5('mask' || node || '-' || f),1,8))::bigint / 4294967296.0::double as u from p), k as (select node, f from u qualify row_number() over (partition by node order by u, f) <= 3) select f::int as f, count(*) as n from k group by f")
def column_sample_of_orders(spark, sf):
    """How often each of six features is among a node's three, with a node per order of the table."""
    from slantree.operators import shapes

    nodes = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("node")).distinct()
    return shapes.feature_mask(nodes, 6, 0.5).groupBy("f").agg(F.count("*").alias("n"))
