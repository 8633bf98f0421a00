"""More queries, each with equivalent SQL: scoring and decisions, rounds of boosting, tree shapes, sweeps, further analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantree.entries import BINNED, BINS, COLS, DIRECTIONS, FIXED, G, HIST, M, PRED, PROJECTED, REC, ROTATION, SCORED, V, base, binned, graded, missing, predicted, projected, query, r, records, scored3, u_sql
from slantree.functions import analysis, metrics
from slantree.operators import gradients, ordered, prepare, shapes, splits
from slantree.plans import boost
from slantree.plans.trees import Node, Tree

# --- scoring and decisions -------------------------------------------------------------------------

RATE, INIT = 0.3, [0.1, -0.1]
#: Two small trees of two classes: an axis root with an oblique child, and an oblique root.
TREES = [
    Tree({0: Node(0, [], [1.0, 0, 0], 25.0, False), 1: Node(1, [], [0.0, 1.0, -0.6], 0.02, True), 2: Node(2, [0.5, -0.4]), 3: Node(3, [-0.8, 0.7]), 4: Node(4, [0.2, 0.1])}),
    Tree({0: Node(0, [], [0.001, 1.0, -0.5], 0.05, True), 1: Node(1, [0.3, -0.6]), 2: Node(2, [-0.2, 0.9])}),
]
MEANS = [25.5, 0.05, 0.04]


def toy_model(prior: list[float]) -> boost.ObliqueModel:
    model = boost.ObliqueModel(TREES, INIT, prior, MEANS, True, COLS)
    return model._set(featuresCols=COLS, learningRate=RATE)


def _value_sql(k: int) -> str:
    x = [f"coalesce({c}, {m}::double)" for c, m in zip(COLS, MEANS)]
    t0 = f"case when coalesce(x0 < 25.0::double, false) then (case when {x[1]}*1.0::double + {x[2]}*-0.6::double < 0.02::double then {TREES[0].nodes[3].leaf[k]} else {TREES[0].nodes[4].leaf[k]} end) else {TREES[0].nodes[2].leaf[k]} end"
    t1 = f"case when {x[0]}*0.001::double + {x[1]}*1.0::double + {x[2]}*-0.5::double < 0.05::double then {TREES[1].nodes[1].leaf[k]} else {TREES[1].nodes[2].leaf[k]} end"
    return f"{INIT[k]}::double + {RATE}::double*({t0})::double + {RATE}::double*({t1})::double"


SCORES = M + f", s as (select y, {_value_sql(0)} as f0, {_value_sql(1)} as f1 from m), p as (select *, exp(f0)/(exp(f0)+exp(f1)) as p0, exp(f1)/(exp(f0)+exp(f1)) as p1 from s)"


def scored(spark, sf, prior=(0.5, 0.5), **params) -> DataFrame:
    return toy_model(list(prior))._set(**params).transform(missing(spark, sf).select("y", *COLS))


@query(SCORES + " select round(f0,6) as f0, round(f1,6) as f1, count(*) as n from s group by all")
def ensemble_score(spark, sf):
    """All trees of a broadcast model, in Arrow batches."""
    s = scored(spark, sf)
    return s.groupBy(r(F.col("rawPrediction")[0]).alias("f0"), r(F.col("rawPrediction")[1]).alias("f1")).agg(F.count("*").alias("n"))


@query(SCORES + " select round(f0,6) as f0, round(f1,6) as f1, count(*) as n from s group by all")
def ensemble_score_expressions(spark, sf):
    """The same model as column expressions."""
    m = toy_model([0.5, 0.5]).margins()
    return missing(spark, sf).groupBy(r(m[0]).alias("f0"), r(m[1]).alias("f1")).agg(F.count("*").alias("n"))


@query(SCORES + " select y, round(avg(p0),6) as p0, round(avg(p1),6) as p1, count(*) as n from p group by y")
def ensemble_proba(spark, sf):
    return scored(spark, sf).groupBy("y").agg(*[r(F.avg(F.col("probability")[i])).alias(f"p{i}") for i in range(2)], F.count("*").alias("n"))


@query(SCORES + " select y, (p1 > p0)::int as prediction, count(*) as n from p group by all")
def predict_argmax(spark, sf):
    return scored(spark, sf).groupBy("y", "prediction").agg(F.count("*").alias("n"))


@query(SCORES + " select y, (p1 / sqrt(0.9::double) > p0 / sqrt(0.1::double))::int as prediction, count(*) as n from p group by all")
def balanced_decision(spark, sf):
    """Probabilities divided by priors to the power of one half."""
    return scored(spark, sf, (0.1, 0.9), balanced=True, priorAlpha=0.5).groupBy("y", "prediction").agg(F.count("*").alias("n"))


@query(SCORED + ", o as (select c3, f1-f0 as m0, f2-f1 as m1, f0-f2 as m2 from s), ex as (select c3, exp(m0) as e0, exp(m1) as e1, exp(m2) as e2 from o) select c3, round(avg(e0/(e0+e1+e2)),6) as p0, round(avg(e1/(e0+e1+e2)),6) as p1, round(avg(e2/(e0+e1+e2)),6) as p2 from ex group by c3")
def ovr_softmax(spark, sf):
    """Binary margins of one model per class, combined by softmax."""
    d = scored3(spark, sf)
    p = gradients.softmax([F.col("f1") - F.col("f0"), F.col("f2") - F.col("f1"), F.col("f0") - F.col("f2")])
    return d.groupBy("c3").agg(*[r(F.avg(v)).alias(f"p{i}") for i, v in enumerate(p)])


@query(V + " select y, 1 - y as n0, count(*) as n from v group by all")
def onehot_label(spark, sf):
    return base(spark, sf).groupBy("y", (F.col("y") == 0).cast("int").alias("n0")).agg(F.count("*").alias("n"))


# --- metrics of several classes ---------------------------------------------------------------------

PROBA = SCORED + ", q3 as (select c3, p0, p1, p2 from p)"


def proba3(spark, sf) -> DataFrame:
    return scored3(spark, sf).select(F.col("c3").alias("y"), F.array(*gradients.softmax([F.col(f"f{i}") for i in range(3)])).alias("probability"))


def _auc_sql(i: int) -> str:
    return f"select {i} as y, (select sum(p*(lower+q/2.0))/(sum(p)::double*sum(q)) from (select *, coalesce(sum(q) over (order by s rows between unbounded preceding and 1 preceding),0) as lower from (select round(p{i},4) as s, sum((c3={i})::int) as p, sum((c3<>{i})::int) as q from q3 group by 1))) as v"


@query(PROBA + " select y, round(v,6) as value from (" + " union all ".join(_auc_sql(i) for i in range(3)) + ")")
def macro_roc_auc(spark, sf):
    d = proba3(spark, sf).withColumn("probability", F.transform("probability", lambda p: F.round(p, 4)))
    return metrics.one_vs_rest(d, 3, metrics.roc_auc).select("y", r("value").alias("value"))


def _ap_sql(i: int) -> str:
    return f"select {i} as y, (select sum(p*prec)/sum(p) from (select p, sum(p) over (order by s desc)/sum(n) over (order by s desc) as prec from (select round(p{i},4) as s, sum((c3={i})::int) as p, count(*) as n from q3 group by 1))) as v"


@query(PROBA + " select y, round(v,6) as value from (" + " union all ".join(_ap_sql(i) for i in range(3)) + ")")
def macro_average_precision(spark, sf):
    d = proba3(spark, sf).withColumn("probability", F.transform("probability", lambda p: F.round(p, 4)))
    return metrics.one_vs_rest(d, 3, metrics.average_precision).select("y", r("value").alias("value"))


@query(PROBA + ", cl as (select c3, " + ", ".join(f"least(greatest(p{i}, 1e-7::double), 1-1e-7::double) as p{i}" for i in range(3)) + " from q3) select round(avg(-ln(case c3 when 0 then p0 when 1 then p1 else p2 end / (p0+p1+p2))),6) as log_loss from cl")
def multiclass_log_loss(spark, sf):
    return metrics.multi_log_loss(proba3(spark, sf)).select(r("log_loss").alias("log_loss"))


# --- rounds of boosting -----------------------------------------------------------------------------

STEPS = 0.5


def _stump_sql(t: int) -> str:
    """One round of squared-error boosting on bins: gradients, the best cut, and new scores."""
    before = f"z{t}"
    hist = " union all ".join(f"select {i} as f, b_{i} as bin, sum(g) as G, count(*)::double as H, count(*) as n from e{t} group by b_{i}" for i in range(3))
    side = " ".join(f"when f = {i} then b_{i} <= cut" for i in range(3))
    return f"""e{t} as (select *, score - y as g from {before}), h{t} as ({hist}),
 w{t} as (select *, sum(G) over (partition by f) as tg, sum(H) over (partition by f) as th, sum(n) over (partition by f) as tn, sum(G) over o as lg, sum(H) over o as lh, sum(n) over o as ln from h{t} window o as (partition by f order by bin)),
 c{t} as (select f, bin as cut, lg, lh, tg, th from (select *, 0.5*(lg*lg/(lh+1+1e-8)+(tg-lg)*(tg-lg)/(th-lh+1+1e-8)-tg*tg/(th+1+1e-8)) as gain from w{t} where ln >= 10 and tn-ln >= 10) order by gain desc, f, cut limit 1),
 z{t + 1} as (select y, b_0, b_1, b_2, score + {STEPS}::double * case when (case {side} end) then -lg/(lh+1+1e-8) else -(tg-lg)/(th-lh+1+1e-8) end as score from e{t}, c{t})"""


VB = V + ", vb as (select v.*, " + ", ".join(f"case when {c} is null then {BINS - 1} else least({BINS - 2}, greatest(0, floor(({c} - {FIXED[c][0]}::double) * ({BINS - 1} / ({FIXED[c][1]}::double - {FIXED[c][0]}::double + 1e-8::double)))))::int end as b_{i}" for i, c in enumerate(COLS)) + " from v)"


def stumps(spark, sf, rounds: int) -> DataFrame:
    d = binned(base(spark, sf)).select(F.col("y").cast("double").alias("y"), "b_0", "b_1", "b_2", F.lit(0.5).alias("score"))
    for _ in range(rounds):
        g = d.withColumns({"node": F.lit(0), "g0": gradients.regression_gradient("l2", F.col("score"), F.col("y")), "h0": F.lit(1.0)})
        cut = splits.best(splits.scan(splits.histogram(g, ["b_0", "b_1", "b_2"], 1), 1, BINS, sums=True)).first()
        left, right = (-cut["l_G0"] / (cut["l_H0"] + 1 + 1e-8), -(cut["t_G0"] - cut["l_G0"]) / (cut["t_H0"] - cut["l_H0"] + 1 + 1e-8))
        d = d.withColumn("score", F.col("score") + STEPS * F.when(F.col(f"b_{cut['f']}") <= cut["bin"], F.lit(left)).otherwise(F.lit(right)))
    return d


@query(VB + f", z0 as (select y::double as y, b_0, b_1, b_2, 0.5::double as score from vb), {_stump_sql(0)}, {_stump_sql(1)} select round(score,6) as score, count(*) as n, round(avg((score-y)*(score-y)),6) as mse from z2 group by 1")
def boost_two_rounds(spark, sf):
    return stumps(spark, sf, 2).groupBy(r("score").alias("score")).agg(F.count("*").alias("n"), r(F.avg((F.col("score") - F.col("y")) ** 2)).alias("mse"))


STAGES = V + ", st as (select {k: k, a: x0, b: x1, c: x2, d: price} as k, y, t::int as tree_id, case t when 0 then 0.02::double*(x0-25.5) when 1 then 8::double*(x1-0.05) when 2 then -6::double*(x2-0.04) else 0.01::double*(25.5-x0) end as value from v, range(4) q(t))"


def stage_values(spark, sf) -> DataFrame:
    """A row per lineitem row with the values of its trees; the key alone repeats on the smallest tables."""
    values = [0.02 * (F.col("x0") - 25.5), 8 * (F.col("x1") - 0.05), -6 * (F.col("x2") - 0.04), 0.01 * (25.5 - F.col("x0"))]
    return base(spark, sf).select(F.struct("k", "x0", "x1", "x2", "price").alias("row_id"), "y", F.array(*values).alias("values"))


STAGED = STAGES + ", cum as (select *, sum(value) over (partition by k order by tree_id rows between unbounded preceding and current row) as f from st), l as (select tree_id, avg(ln(1+exp(-f*(2*y-1)))) as loss from cum group by tree_id)"


def staged_losses(spark, sf) -> DataFrame:
    return metrics.staged_values(stage_values(spark, sf), lambda f: F.log(1 + F.exp(-f * (2 * F.col("y") - 1))))


@query(STAGED + " select tree_id, round(loss,6) as loss from l")
def staged_loss(spark, sf):
    return staged_losses(spark, sf).withColumn("loss", r("loss"))


@query(STAGED + ", b as (select tree_id, (select arg_min(q.tree_id, q.loss) from l q where q.tree_id <= l.tree_id) as best from l), s as (select min(tree_id) as stop_round from b where tree_id - best >= 1) select max(best) as best_round, stop_round from b, s where stop_round is null or tree_id <= stop_round group by stop_round")
def early_stop_round(spark, sf):
    return metrics.stopping_round(staged_losses(spark, sf), 1)


# --- categories and masks ----------------------------------------------------------------------------

CATS = V + ", g as (select cat, 0.5 - y as g, 0.25 as h from v), s as (select cat, sum(g)/(sum(h)+1.0+1e-8) as score from g group by cat), rk as (select cat, row_number() over (order by score, cat) - 1 as rank from s)"


@query(CATS + " select cat, rank, least(15, floor(rank * 16 / (3 - 1 + 1e-8)))::int as bin, count(*) as n from v join rk using (cat) group by all")
def category_bins(spark, sf):
    """Rows look up their category's rank, and its bin."""
    b = base(spark, sf)
    ranks = prepare.category_ranks(b.select("cat", (0.5 - F.col("y")).alias("g"), F.lit(0.25).alias("h")), "cat", "g", "h")
    return b.join(F.broadcast(ranks.select("cat", "rank")), "cat").groupBy("cat", "rank", shapes.category_bin(F.col("rank"), 3, 16).alias("bin")).agg(F.count("*").alias("n"))


@query("with tr as (select distinct p_brand as v from part where p_partkey % 5 <> 0), d as (select v, row_number() over (order by v) - 1 as id from tr) select p_partkey % 5 = 0 as held, (id is null)::int as unseen, count(*) as n, sum(coalesce(id, -1))::bigint as total from part left join d on p_brand = v group by all")
def ordinal_encode_train_only(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").withColumn("held", F.col("p_partkey") % 5 == 0)
    values = prepare.dictionary(part.where("not held"), "p_brand")
    card = values.count()
    out = prepare.encode(part, "p_brand", values, "code", card)
    code = F.when(F.col("code") == card, None).otherwise(F.col("code"))
    return out.groupBy("held", code.isNull().cast("int").alias("unseen")).agg(F.count("*").alias("n"), F.sum(F.coalesce(code, F.lit(-1))).alias("total"))


@query("with p as (select n as node, f from range(4) a(n), range(6) b(f)), u as (select *, ('0x' || substr(md5('mask' || node || '-' || f),1,8))::bigint / 4294967296.0::double as u from p) select node::int as node, f::int as f from u qualify row_number() over (partition by node order by u, f) <= 3")
def column_sample_mask(spark, sf):
    nodes = spark.range(4).select(F.col("id").cast("int").alias("node"))
    return shapes.feature_mask(nodes, 6, 0.5)


@query("with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders) select o_orderkey from o where i in (select floor(k * (select count(*) from orders) / 500)::bigint from range(500) x(k))")
def stride_sample(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return gradients.stride(o, "o_orderkey", o.count(), 500).select("o_orderkey")


@query(V + f" select y, count(*) as n from v where k not in (select k from v where {u_sql('sub')} < 0.3) group by y")
def out_of_sample_rows(spark, sf):
    b = base(spark, sf)
    return b.join(gradients.bernoulli(b, "k", 0.3).select("k"), "k", "left_anti").groupBy("y").agg(F.count("*").alias("n"))


# --- split search variants ----------------------------------------------------------------------------


def _scan_sql(lam: str, alpha: str, weight: str) -> str:
    def t(g: str) -> str:
        return f"power(sign({g})*greatest(abs({g})-{alpha},0),2)"

    return f""", tt as (select *, sum(G0) over w as tg, sum(H0) over w as th, sum(n) over w as tn, coalesce(sum(case when bin={BINS - 1} then G0 end) over w,0) as mg, coalesce(sum(case when bin={BINS - 1} then H0 end) over w,0) as mh, coalesce(sum(case when bin={BINS - 1} then n end) over w,0) as mn from hist window w as (partition by node, f)),
 ll as (select *, sum(G0) over w as lg, sum(H0) over w as lh, sum(n) over w as ln from tt where bin < {BINS - 1} window w as (partition by node, f order by bin)),
 ss as (select node, f, bin, nl as nan_left, lg+nl*mg as ag, lh+nl*mh as ah, ln+nl*mn as an, tg, th, tn from ll, (values (0),(1)) x(nl) where mn > 0 or nl = 1),
 cuts as (select node, f, bin, nan_left, 0.5*({t('ag')}/(ah+{lam}+1e-8) + {t('(tg-ag)')}/(th-ah+{lam}+1e-8) - {t('tg')}/(th+{lam}+1e-8)) as gain, an::bigint as n_left, (tn-an)::bigint as n_right from ss where an >= 10 and tn-an >= 10 and ah >= {weight} and th-ah >= {weight})"""


@query(HIST + _scan_sql("2.0", "5.0", "100.0") + " select node, f, bin, nan_left, round(gain,4) as gain, n_left, n_right from cuts where gain >= 1.0")
def regularised_split_gains(spark, sf):
    """L1 on gradient sums, a least hessian of a side, and a least gain."""
    cuts = splits.scan(splits.histogram(graded(spark, sf), ["b_0", "b_1", "b_2"], 1), 1, BINS, lam=2.0, alpha=5.0, min_weight=100.0)
    return cuts.where("gain >= 1.0").withColumn("gain", r("gain", 4))


@query(G + ", s as (select node, sum(g0) as G0, sum(h0) as H0 from g group by node), p as (select -sum(G0)/(sum(H0)+1.0+1e-8) as up from s) select node, round((H0 * (-G0/(H0+1.0+1e-8)) + 1.0*up)/(H0+1.0+1e-8),8) as leaf0 from s, p")
def leaf_smoothing(spark, sf):
    g = graded(spark, sf)
    root = splits.leaf_values(splits.totals(g.withColumn("node", F.lit(0)), 1), 1)
    return shapes.smoothed(splits.totals(g, 1), root, 1).select("node", r("leaf0", 8).alias("leaf0"))


@query("""with o as (select o_totalprice::double as p, (case when o_totalprice > 200000 then 0.5 else -0.5 end + (o_orderkey % 7 - 3)/10.0)::double as g, 0.25::double as h from orders),
d as (select p, sum(g) as g, sum(h) as h, count(*) as n from o group by p), t as (select sum(g) as tg, sum(h) as th, count(*) as tn, greatest(1, count(*)//64) as step from o),
c as (select d.*, sum(d.g) over w as lg, sum(d.h) over w as lh, sum(d.n) over w as ln, lead(p) over (order by p) as nx from d window w as (order by p)),
k as (select *, 0.5*lg*lg/(lh+1+1e-8) + 0.5*(tg-lg)*(tg-lg)/(th-lh+1+1e-8) - 0.5*tg*tg/(th+1+1e-8) as gain from c, t where floor(ln/step) > floor((ln-n)/step) and ln < tn and lh >= 0.1 and th-lh >= 0.1)
select round((p+nx)/2,4) as threshold, round(gain,4) as gain, ln::bigint as n_left from k order by k.gain desc, p limit 1""")
def exact_threshold_scan(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_totalprice").cast("double").alias("p"), F.expr("double(case when o_totalprice > 200000 then 0.5D else -0.5D end + (o_orderkey % 7 - 3)/10D)").alias("g0"), F.lit(0.25).alias("h0"))
    return shapes.sorted_threshold(o, "p").select(r("threshold", 4).alias("threshold"), r("gain", 4).alias("gain"), "n_left")


OBLIVIOUS = PROJECTED.replace("p, g0, h0, y from g", "p, g0, h0, y, case when cat = 'A' then 1 else 2 end as node from g") + """, rg as (select node, dir, min(p) as lo, max(p) as hi from pr group by all),
 oh as (select node, dir, least(63, floor((p-lo)/(hi-lo+1e-8::double)*64))::int as bin, sum(g0) as G0, sum(h0) as H0, count(*) as n from pr join rg using (node, dir) group by all),
 t as (select *, sum(G0) over (partition by node, dir) as tg, sum(H0) over (partition by node, dir) as th, sum(n) over (partition by node, dir) as tn, sum(G0) over w as lg, sum(H0) over w as lh, sum(n) over w as ln from oh window w as (partition by node, dir order by bin)),
 c as (select node, dir, 0.5*(lg*lg/(lh+1.0+1e-8)+(tg-lg)*(tg-lg)/(th-lh+1.0+1e-8)-tg*tg/(th+1.0+1e-8)) as gain from t where ln >= 10 and tn-ln >= 10)"""


def two_nodes(spark, sf) -> DataFrame:
    g = base(spark, sf).withColumns({"g0": 0.5 - F.col("y"), "h0": F.lit(0.25), "node": F.when(F.col("cat") == "A", 1).otherwise(2)})
    return splits.project_all(g, DIRECTIONS, COLS, ["node", "g0", "h0", "y"])


@query(OBLIVIOUS + ", b as (select dir, sum(gain) as gain from (select node, dir, max(gain) as gain from c group by all) group by dir) select dir, round(gain,4) as gain from b order by b.gain desc, dir limit 1")
def oblivious_level_split(spark, sf):
    cuts = splits.scan(splits.oblique_histogram(two_nodes(spark, sf), 1), 1, 65, key="dir")
    return shapes.oblivious_split(cuts).select("dir", r("gain", 4).alias("gain"))


@query(V + " select ((x0 < 25)::int * 2 + (x1 < 0.05)::int) * 2 + (x0*0.0010917::double + x1 < 0.0535::double)::int as leaf, y, count(*) as n from v group by all")
def oblivious_leaf_codes(spark, sf):
    tests = [F.col("x0") < 25, F.col("x1") < 0.05, splits.project([0.0010917, 1.0], COLS[:2]) < 0.0535]
    return base(spark, sf).groupBy(shapes.leaf_code(tests).alias("leaf"), "y").agg(F.count("*").alias("n"))


@query(V + """, g as (select case when cat = 'A' then 1 else 2 end as node, x0*0.0010917::double + x1*1.0::double + x2*-0.6123418::double as p, 0.5::double - y as g, 0.25::double as h from v),
 q as (select unnest(range(1,20)) as k, unnest(quantile_cont(p, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) as e from g), s as (select k, e, node, sum(case when p<e then g else 0 end) as lg, sum(case when p<e then h else 0 end) as lh, count(*) filter (where p<e) as ln, sum(g) as tg, sum(h) as th, count(*) as tn from g, q group by all),
 c as (select k, e, sum(case when ln >= 4 and tn-ln >= 4 then 0.5*lg*lg/(lh+1+1e-8)+0.5*(tg-lg)*(tg-lg)/(th-lh+1+1e-8)-0.5*tg*tg/(th+1+1e-8) else 0 end) as gain from s group by all) select round(e,6) as threshold, round(gain,3) as gain from c order by c.gain desc, k limit 1""")
def fully_oblivious_split(spark, sf):
    d = two_nodes(spark, sf).where("dir = 0")
    return shapes.pooled_split(d, "p").select(r("threshold").alias("threshold"), r("gain", 3).alias("gain"))


BLENDS = shapes.blends(DIRECTIONS[0], [0.0, 1.0, 0.0])
BLENDED = V + ", g as (select *, 0.5::double-y as g0, 0.25::double as h0 from v), pr as (" + " union all ".join(f"select {d} as dir, {' + '.join(f'{c}*{w!r}::double' for w, c in zip(ws, COLS) if w)} as p, g0, h0 from g" for d, ws in enumerate(BLENDS)) + """), rg as (select dir, min(p) as lo, max(p) as hi from pr group by dir),
 oh as (select dir, least(63, floor((p-lo)/(hi-lo+1e-8::double)*64))::int as bin, sum(g0) as G0, sum(h0) as H0, count(*) as n from pr join rg using (dir) group by all),
 t as (select *, sum(G0) over (partition by dir) as tg, sum(H0) over (partition by dir) as th, sum(n) over (partition by dir) as tn, sum(G0) over w as lg, sum(H0) over w as lh, sum(n) over w as ln from oh window w as (partition by dir order by bin)),
 c as (select dir, 0.5*(lg*lg/(lh+1.0+1e-8)+(tg-lg)*(tg-lg)/(th-lh+1.0+1e-8)-tg*tg/(th+1.0+1e-8)) as gain from t where ln >= 10 and tn-ln >= 10)"""


@query(BLENDED + " select dir, round(max(gain),3) as gain from c group by dir")
def alpha_blend_split(spark, sf):
    """Shares of an oblique and an axis direction, and the best gain of each."""
    g = base(spark, sf).withColumns({"g0": 0.5 - F.col("y"), "h0": F.lit(0.25), "node": F.lit(0)})
    cuts = splits.scan(splits.oblique_histogram(splits.project_all(g, BLENDS, COLS, ["node", "g0", "h0"]), 1), 1, 65, key="dir")
    return cuts.groupBy("dir").agg(r(F.max("gain"), 3).alias("gain"))


COV = V + ", g as (select *, 0.5::double-y as g0 from v), c as (select -sum(x0*g0) as a, -sum(x1*g0) as b, -sum(x2*g0) as c from g)"


@query(COV + " select 0 as f, round(a/sqrt(a*a+b*b+c*c),6) as w from c union all select 1, round(b/sqrt(a*a+b*b+c*c),6) from c union all select 2, round(c/sqrt(a*a+b*b+c*c),6) from c")
def covariance_direction(spark, sf):
    g = base(spark, sf).withColumn("g0", 0.5 - F.col("y"))
    return shapes.covariance_direction(g, COLS).withColumn("w", r("w"))


@query(G + " select node, round(var_pop(g0)*count(*)/sum(g0*g0),6) as variance from g group by node")
def gradient_variance(spark, sf):
    return shapes.gradient_variance(graded(spark, sf)).withColumn("variance", r("variance"))


@query(G + ", a as (" + " union all ".join(f"select node, {i} as f, sum({c}*g0)*sum({c}*g0)/(sum(h0*{c}*{c})+1.0+1e-8) as j from g where {c} is not null group by node" for i, c in enumerate(COLS)) + ") select node, f, round(j,3) as proxy from a")
def linear_gain_proxy(spark, sf):
    """(x'g)^2 / (x'Hx + lambda): the square of the marginal score."""
    s = splits.sis_scores(graded(spark, sf), COLS, "g0", "h0")
    return s.select("node", "f", r(F.col("sis") * F.col("sis"), 3).alias("proxy"))


# --- sweeps ---------------------------------------------------------------------------------------------


@query(V + " " + " union all ".join(f"select {s}::double as strength, round(avg(abs({' + '.join(f'{c}*{q[i][0]!r}::double' for i, c in enumerate(COLS))})),6) as mean_abs from v" for s in (0.0, 0.25, 0.5, 0.75, 1.0) for q in [prepare.blended_rotation(ROTATION, s)]))
def rotation_sweep(spark, sf):
    b = base(spark, sf)
    columns = [F.struct(F.lit(s).alias("strength"), F.avg(F.abs(sum((F.col(c) * F.lit(prepare.blended_rotation(ROTATION, s)[i][0]) for i, c in enumerate(COLS)), F.lit(0.0)))).alias("mean_abs")) for s in (0.0, 0.25, 0.5, 0.75, 1.0)]
    return b.agg(F.array(*columns).alias("a")).select(F.inline("a")).withColumn("mean_abs", r("mean_abs"))


@query(V + " " + " union all ".join(f"select {s}::double as share, count(*) filter (where {u_sql('missx0')} < {s}) as n_missing, round(avg(case when {u_sql('missx0')} < {s} then null else x0 end),6) as mean from v" for s in (0.0, 0.1, 0.2, 0.3, 0.4)))
def missing_sweep(spark, sf):
    out = None
    for share in (0.0, 0.1, 0.2, 0.3, 0.4):
        one = prepare.inject_missing(base(spark, sf), ["x0"], "k", share).agg((F.count("*") - F.count("x0")).alias("n_missing"), r(F.avg("x0")).alias("mean")).select(F.lit(share).alias("share"), "n_missing", "mean")
        out = one if out is None else out.union(one)
    return out


@query(V + " " + " union all ".join(f"select {c} as card, max(n) as top, count(*) as used from (select floor({u_sql(f'card{c}')} * {c}) as v, count(*) as n from v group by 1)" for c in (2, 5, 10, 20, 50, 100)))
def cardinality_sweep(spark, sf):
    cards = (2, 5, 10, 20, 50, 100)
    d = prepare.hashed_categories(base(spark, sf), "k", cards)
    long = d.select(F.inline(F.array(*[F.struct(F.lit(c).alias("card"), F.col(f"c{c}").alias("v")) for c in cards])))
    return long.groupBy("card", "v").agg(F.count("*").alias("n")).groupBy("card").agg(F.max("n").alias("top"), F.count("*").alias("used"))


# --- further analysis -------------------------------------------------------------------------------------


@query(REC + ", s as (select gain, len(list_filter(w, lambda x: x <> 0)) > 1 as several from rec), t as (select sum(case when several then 0 else gain end) as a, sum(case when several then gain else 0 end) as b from s) select round(a,3) as axis_gain, round(b,3) as oblique_gain, round(a/(a+b),6) as axis_share, round(b/(a+b),6) as oblique_share from t")
def gain_decomposition(spark, sf):
    d = analysis.gain_decomposition(records(spark, sf))
    return d.select(r("axis_gain", 3).alias("axis_gain"), r("oblique_gain", 3).alias("oblique_gain"), r("axis_share").alias("axis_share"), r("oblique_share").alias("oblique_share"))


@query(REC + ", b as (select tree_id, case when depth <= 1 then 0 else 1 end as bucket, family, gain from rec), t as (select * from b qualify row_number() over (partition by tree_id, bucket order by gain desc, family) = 1), c as (select bucket, family, count(*) as n from t group by all) select bucket, family, round(n/sum(n) over (partition by bucket),6) as share from c")
def family_win_by_depth(spark, sf):
    return analysis.win_by_bucket(records(spark, sf), 1).withColumn("share", r("share"))


@query(REC + " select depth, round(avg(abs(w[1])/30/gain),6) as mean_ratio, round(max(abs(w[1])/30/gain),6) as top_ratio, count(*) as n from rec where gain > 0 group by depth")
def fidelity_by_depth(spark, sf):
    d = records(spark, sf).withColumn("proxy", F.abs(F.col("w")[0]) / 30)
    return analysis.fidelity(d, "proxy").withColumns({"mean_ratio": r("mean_ratio"), "top_ratio": r("top_ratio")})


@query("with c as (select (l_quantity >= 10)::int + (l_quantity >= 25)::int + (l_quantity >= 40)::int as bucket, l_returnflag as cat, count(*) as n from lineitem group by all) select bucket, cat, n from c qualify row_number() over (partition by bucket order by n desc, cat) = 1")
def break_even_buckets(spark, sf):
    return analysis.mode_by_bucket(base(spark, sf), "x0", "cat", [10, 25, 40])


@query(STAGES + " select a.tree_id as a, b.tree_id as b, round(corr(a.value, b.value),6) as corr from st a join st b on a.k = b.k and a.tree_id < b.tree_id group by all")
def tree_pred_correlation(spark, sf):
    return analysis.values_correlation(stage_values(spark, sf)).withColumn("corr", r("corr"))


@query(REC + " select tree_id, node_id, round(max(gain) over (partition by tree_id order by node_id),6) as best from rec")
def running_best_gain(spark, sf):
    return analysis.running_best(records(spark, sf), "tree_id", "node_id", "gain").select("tree_id", "node_id", r("best").alias("best"))


@query(REC + ", q as (select tree_id, gain, row_number() over (partition by tree_id order by gain) as i, count(*) over (partition by tree_id) as n from rec), x as (select tree_id, max(n) as splits, sum(gain*(power(i/n,8)-power((i-1)/n,8))) as expected from q group by tree_id) select splits, round(avg(expected),5) as expected, count(*) as n from x group by splits")
def expected_best_of_draws(spark, sf):
    """The closed form of the bootstrap mean of the largest of eight draws."""
    each = analysis.expected_best(records(spark, sf, "l_orderkey"), ["l_orderkey", "tree_id"], "gain", 8)
    return each.groupBy(F.col("n").alias("splits")).agg(r(F.avg("expected"), 5).alias("expected"), F.count("*").alias("n"))


@query(REC + " select a.tree_id, a.node_id from n a where not exists (select 1 from n b where a.tree_id = b.tree_id and b.node_id < a.node_id and abs(a.w[1]*b.w[1]+a.w[2]*b.w[2]+a.w[3]*b.w[3]) > 0.95*a.nw*b.nw)")
def direction_dedup(spark, sf):
    return analysis.distinct_directions(records(spark, sf)).select("tree_id", "node_id")


@query(REC + ", s as (select tree_id, node_id, list_filter([0,1,2], lambda i: w[i+1] <> 0) as own from rec) select len(list_distinct(list_concat(own, [0,2]))) as size, len(list_filter([0,2], lambda i: not list_contains(own, i))) as fresh, count(*) as n from s group by all")
def support_union(spark, sf):
    d = analysis.widened_support(records(spark, sf), [5.0, 1.0, 3.0], 2)
    return d.groupBy(F.size("support").alias("size"), F.size("fresh").alias("fresh")).agg(F.count("*").alias("n"))


@query("with s as (select (user_id % 6)::int as dataset, event_type as model, avg(value) as v from events group by all) select dataset, max(v) as top, min(v) as low from s group by dataset")
def results_by_dataset(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy((F.col("user_id") % 6).cast("int").alias("dataset"), F.col("event_type").alias("model")).agg(F.avg("value").alias("v"))
    return e.groupBy("dataset").agg(F.max("v").alias("top"), F.min("v").alias("low"))


# --- estimators (no SQL) --------------------------------------------------------------------------------------


@query()
def categorical_classifier(spark, sf):
    """A text category, one-side sampling, a mask of features and validation rows."""
    d = base(spark, sf).select("k", *COLS, "cat", "y").withColumn("v", gradients.uniform(F.col("k"), "valid") < 0.2)
    est = boost.ObliqueBoostClassifier(featuresCols=[*COLS, "cat"], rounds=2, maxDepth=2, learningRate=0.3, validationIndicatorCol="v", colsampleByNode=0.75)
    return est.fit(d).transform(d).groupBy("y", "prediction").agg(F.count("*").alias("n"))


@query()
def custom_objective_tree(spark, sf):
    """One tree on gradients of the caller's own: here the logistic loss at 0."""
    g = base(spark, sf).select(*COLS, (0.5 - F.col("y")).alias("mine"), F.lit(0.25).alias("hess"))
    tree, _ = boost.fit_tree(g, COLS, ["mine"], ["hess"], {"leaves": 4})
    rows = [(n.id, n.leaf[0], n.family) for n in tree.nodes.values()]
    return spark.createDataFrame(rows, "node_id int, leaf double, family string")
