"""Queries of the boosting dataflow and its evaluation, each with equivalent SQL.

The views: `v` is lineitem with three numeric features and a label whose
boundary is oblique; `m` is the same with a tenth of the values missing by a
hash of the row's key; `c` has a category.  Both engines build them from the
same expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slantree.functions import analysis, metrics
from slantree.operators import gradients, ordered, prepare, splits

COLS = ["x0", "x1", "x2"]
KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
LABEL = "case when 69*(l_quantity-25.5) + 63200*(l_discount-0.05) - 38700*(l_tax-0.04) > 0 then 1 else 0 end"
BINS = 16

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def base(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select(F.expr(KEY).alias("k"), F.col("l_quantity").cast("double").alias("x0"), F.col("l_discount").cast("double").alias("x1"), F.col("l_tax").cast("double").alias("x2"), F.col("l_returnflag").alias("cat"), F.col("l_extendedprice").cast("double").alias("price"), F.expr(LABEL).alias("y"))


V = f"with v as (select {KEY} as k, l_quantity::double as x0, l_discount::double as x1, l_tax::double as x2, l_returnflag as cat, l_extendedprice::double as price, {LABEL} as y from lineitem)"


def u_sql(stream: str) -> str:
    return f"('0x' || substr(md5('{stream}' || k),1,8))::bigint / 4294967296.0::double"


def missing(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.inject_missing(base(spark, sf), COLS, "k", 0.1)


M = V + ", m as (select k, cat, price, y, " + ", ".join(f"case when {u_sql('miss' + c)} < 0.1 then null else {c} end as {c}" for c in COLS) + " from v)"


def r(c, n: int = 6):
    return F.round(c, n)


# --- statistics, bins, imputation, dictionaries -------------------------------------------------


@query(M + ", s as (" + " union all ".join(f"select {i} as f, min({c}) as lo, max({c}) as hi, count({c}) as n, round(sum({c})/(count({c})+1e-8), 6) as mean, max({c})-min({c}) > 1e-12 as active from m" for i, c in enumerate(COLS)) + ") select * from s")
def column_stats(spark, sf):
    return prepare.column_stats(missing(spark, sf), COLS).withColumn("mean", r("mean"))


FIXED = {"x0": (1.0, 50.0), "x1": (0.0, 0.1), "x2": (0.0, 0.08)}


def binned(df: DataFrame, bins: int = BINS) -> DataFrame:
    return df.withColumns({f"b_{i}": prepare.bin_of(F.col(c), *FIXED[c], bins) for i, c in enumerate(COLS)})


def bin_sql(c: str, bins: int = BINS) -> str:
    lo, hi = FIXED[c]
    return f"case when {c} is null then {bins - 1} else least({bins - 2}, greatest(0, floor(({c} - {lo}::double) * ({bins - 1} / ({hi}::double - {lo}::double + 1e-8::double)))))::int end"


BINNED = M + ", b as (select *, " + ", ".join(f"{bin_sql(c)} as b_{i}" for i, c in enumerate(COLS)) + " from m)"


@query(BINNED + " select b_0, b_1, b_2, count(*) as n from b group by all")
def numeric_bins(spark, sf):
    return binned(missing(spark, sf)).groupBy("b_0", "b_1", "b_2").agg(F.count("*").alias("n"))


@query(M + " select x0_missing, count(*) as n, round(sum(coalesce(x0, 25.5)), 4) as total from (select *, x0 is null as x0_missing from m) group by 1")
def impute_mean_and_mask(spark, sf):
    return prepare.impute(missing(spark, sf), ["x0"], {"x0": 25.5}).groupBy("x0_missing").agg(F.count("*").alias("n"), r(F.sum("x0"), 4).alias("total"))


@query(M + ", med as (select median(x0) as v from m) select round(sum(coalesce(x0, v)), 4) as total, count(*) as n from m, med")
def fill_median(spark, sf):
    m = missing(spark, sf)
    return prepare.impute(m, ["x0"], {"x0": ordered.quantiles(m, "x0", [0.5])[0]}, flags=False).agg(r(F.sum("x0"), 4).alias("total"), F.count("*").alias("n"))


@query("select o_orderpriority as value, row_number() over (order by o_orderpriority) - 1 as id from (select distinct o_orderpriority from orders)")
def category_dictionary(spark, sf):
    return prepare.dictionary(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderpriority")


@query("""with d as (select v as p_type_value, row_number() over (order by v) - 1 as id from (select distinct p_brand as v from part where p_partkey % 5 <> 0))
select code, count(*) as n from (select coalesce(id, (select count(*) from d))::int as code from part left join d on p_brand = p_type_value) group by 1""")
def category_lookup_with_unseen(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    values = prepare.dictionary(part.where("p_partkey % 5 <> 0"), "p_brand")
    return prepare.encode(part.select("p_brand"), "p_brand", values, "code").groupBy("code").agg(F.count("*").alias("n"))


@query(V + ", g as (select cat, 0.5 - y as g, 0.25 as h from v), s as (select cat, sum(g)/(sum(h)+1.0+1e-8) as score from g group by cat) select cat, round(score, 6) as score, row_number() over (order by score, cat) - 1 as rank from s")
def category_target_ranks(spark, sf):
    g = base(spark, sf).select("cat", (0.5 - F.col("y")).alias("g"), F.lit(0.25).alias("h"))
    return prepare.category_ranks(g, "cat", "g", "h").withColumn("score", r("score"))


ROTATION = [[0.8, 0.6, 0.0], [-0.6, 0.8, 0.0], [0.0, 0.0, 1.0]]


@query(V + " select round(sum(x0*0.8+x1*-0.6),4) as s0, round(sum(x0*0.6+x1*0.8),4) as s1, round(sum(x2),4) as s2 from v")
def rotation(spark, sf):
    return prepare.rotate(base(spark, sf), COLS, ROTATION).agg(*[r(F.sum(f"r{j}"), 4).alias(f"s{j}") for j in range(3)])


@query(V + ", s as (select avg(x0) as a, stddev_pop(x0) as d from v) select round(avg((x0-a)/d),6)+0.0 as mean, round(stddev_pop((x0-a)/d),6) as std, round(max((x0-a)/d),6) as top from v, s")
def standardize(spark, sf):
    z = prepare.standardize(base(spark, sf), ["x0"])
    return z.agg((r(F.avg("x0")) + 0.0).alias("mean"), r(F.stddev_pop("x0")).alias("std"), r(F.max("x0")).alias("top"))


@query(M + " select " + ", ".join(f"count(*) - count({c}) as n_{c}" for c in COLS) + " from m")
def missing_injection(spark, sf):
    return missing(spark, sf).agg(*[(F.count("*") - F.count(c)).alias(f"n_{c}") for c in COLS])


# --- priors, losses, sampling --------------------------------------------------------------------


@query("with c as (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as k, count(*) as n from lineitem group by 1), p as (select *, n/sum(n) over () as prior from c) select k, n, round(prior,6) as prior, round(ln(prior+1e-8) - avg(ln(prior+1e-8)) over (), 6) as init from p")
def class_priors(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr("case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end").alias("y"))
    return gradients.class_priors(li, "y").withColumns({"prior": r("prior"), "init": r("init")})


SCORED = V + ", s as (select *, 0.02*(x0-25) as f0, 3*(x1-0.05) as f1, -2*x2 as f2, case cat when 'A' then 0 when 'N' then 1 else 2 end as c3 from v), e as (select *, greatest(f0,f1,f2) as t from s), q as (select *, exp(f0-t) as e0, exp(f1-t) as e1, exp(f2-t) as e2 from e), p as (select *, e0/(e0+e1+e2) as p0, e1/(e0+e1+e2) as p1, e2/(e0+e1+e2) as p2 from q)"


def scored3(spark, sf) -> DataFrame:
    return base(spark, sf).withColumns({"f0": 0.02 * (F.col("x0") - 25), "f1": 3 * (F.col("x1") - 0.05), "f2": -2 * F.col("x2"), "c3": F.expr("case cat when 'A' then 0 when 'N' then 1 else 2 end")})


@query(SCORED + " select c3, " + ", ".join(f"round(sum(p{i}-(c3={i})::int),4) as g{i}, round(sum(p{i}*(1-p{i})),4) as h{i}" for i in range(3)) + " from p group by c3")
def softmax_gradients(spark, sf):
    d = scored3(spark, sf)
    g, h = gradients.softmax_gradients([F.col(f"f{i}") for i in range(3)], F.col("c3"))
    return d.groupBy("c3").agg(*[r(F.sum(v), 4).alias(f"g{i}") for i, v in enumerate(g)], *[r(F.sum(v), 4).alias(f"h{i}") for i, v in enumerate(h)])


@query("with o as (select o_totalprice::double as y, 250000.0::double as f from orders) select round(sum(f-y),2) as squared, sum(sign(f-y))::double as absolute, round(sum(least(greatest(f-y,-1000),1000)),2) as huber from o")
def regression_gradients(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_totalprice").cast("double").alias("y"))
    f = F.lit(250000.0)
    return o.agg(*[r(F.sum(gradients.regression_gradient(loss, f, F.col("y"), 1000.0)), 2).alias(n) for loss, n in (("squared_error", "squared"), ("absolute_error", "absolute"), ("huber", "huber"))])


@query("with o as (select o_totalprice::double as y, (1 + o_orderkey % 3)::double as w from orders), c as (select y, sum(w) over (order by y) as run, sum(w) over () as total from o) select round((select avg(y) from o),4) as mean, round((select sum(y*w)/sum(w) from o),4) as weighted_mean, (select median(y) from o) as median, (select min(y) from c where run >= total/2) as weighted_median")
def initial_values(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_totalprice").cast("double").alias("y"), (1 + F.col("o_orderkey") % 3).cast("double").alias("w")).persist()
    row = (round(gradients.initial_value(o, "l2", "y"), 4), round(gradients.initial_value(o, "l2", "y", "w"), 4), gradients.initial_value(o, "l1", "y"), gradients.initial_value(o, "huber", "y", "w"))
    return spark.createDataFrame([row], "mean double, weighted_mean double, median double, weighted_median double")


GOSS_N = "(select count(*) from s)"


@query(V + f""", s as (select k, abs(0.5 - y) * x0 as score from v), n as (select count(*) as n, floor(0.2*count(*))::bigint as t from s),
ranked as (select k, score, row_number() over (order by score desc, k) as rk from s),
rest as (select k, row_number() over (order by {u_sql('goss')}, k) as rr from ranked, n where rk > t)
select case when rk <= t then 1.0 else 8.0 end as amplify, count(*) as n, round(sum(score),3) as total from ranked, n
where rk <= t or k in (select k from rest, n where rr <= floor(0.1*(n.n-n.t))) group by 1""")
def goss_sampling(spark, sf):
    s = base(spark, sf).select("k", (F.abs(0.5 - F.col("y")) * F.col("x0")).alias("score"))
    return gradients.goss(s, "score", "k", 0.2, 0.1).groupBy("amplify").agg(F.count("*").alias("n"), r(F.sum("score"), 3).alias("total"))


@query("""with s as (select l_orderkey * 10 + l_linenumber as id from lineitem), n as (select count(*) as n, floor(0.7*count(*)) as t from s),
ranked as (select id, row_number() over (order by id) as rk from s),
rest as (select id, row_number() over (order by ('0x' || substr(md5('goss' || id),1,8))::bigint / 4294967296.0::double, id) as rr from ranked, n where rk > t)
select case when rk <= t then 1.0 else 3.0 end as amplify, count(*) as n, sum(id % 1000)::bigint as total from ranked, n
where rk <= t or id in (select id from rest, n where rr <= floor(0.1*(n.n-n.t))) group by 1""")
def goss_ties(spark, sf):
    """Every score ties, as those of the first round on a balanced label do: a numeric key decides."""
    s = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit(0.5).alias("score"))
    kept = gradients.goss(s, "score", "id", 0.7, 0.1)
    return kept.groupBy(F.round("amplify", 6).alias("amplify")).agg(F.count("*").alias("n"), F.sum(F.col("id") % 1000).alias("total"))


@query(V + f" select y, count(*) as n from v where {u_sql('sub')} < 0.3 group by y")
def bernoulli_subsample(spark, sf):
    return gradients.bernoulli(base(spark, sf), "k", 0.3).groupBy("y").agg(F.count("*").alias("n"))


@query(V + f" select k, y from v order by {u_sql('ns')}, k limit 100")
def sample_without_replacement(spark, sf):
    return gradients.without_replacement(base(spark, sf), "k", 100).select("k", "y")


@query(V + f", s as (select y, row_number() over (partition by y order by {u_sql('split')}, k) as rk, count(*) over (partition by y) as n from v) select y, case when rk <= floor(0.2*n) then 'test' else 'train' end as part, count(*) as n from s group by 1, 2")
def stratified_split(spark, sf):
    return gradients.stratified(base(spark, sf), "y", "k", 0.2).groupBy("y", "part").agg(F.count("*").alias("n"))


# --- split search ---------------------------------------------------------------------------------


def graded(spark, sf) -> DataFrame:
    """First-round binary gradients (p = 1/2) in two nodes, binned."""
    return binned(missing(spark, sf)).withColumns({"g0": 0.5 - F.col("y"), "h0": F.lit(0.25), "node": F.when(F.col("cat") == "A", 1).otherwise(2)})


G = BINNED + ", g as (select *, 0.5::double - y as g0, 0.25::double as h0, case when cat = 'A' then 1 else 2 end as node from b)"
HIST = G + ", hist as (" + " union all ".join(f"select node, {i} as f, b_{i} as bin, sum(g0) as G0, sum(h0) as H0, count(*) as n from g group by all" for i in range(3)) + ")"
CODES = ["b_0", "b_1", "b_2"]


@query(HIST + " select * from hist")
def gradient_histogram(spark, sf):
    return splits.histogram(graded(spark, sf), CODES, 1)


@query(HIST + " select f, bin, p.G0 - coalesce(c.G0,0) as G0, p.H0 - coalesce(c.H0,0) as H0, p.n - coalesce(c.n,0) as n from (select f, bin, sum(G0) as G0, sum(H0) as H0, sum(n)::bigint as n from hist group by all) p left join (select * from hist where node = 1) c using (f, bin)")
def histogram_subtraction(spark, sf):
    g = graded(spark, sf)
    whole = splits.histogram(g.withColumn("node", F.lit(0)), CODES, 1)
    return splits.subtract(whole, splits.histogram(g.where("node = 1"), CODES, 1), 1)


SCAN = HIST + f""", t as (select *, sum(G0) over w as tg, sum(H0) over w as th, sum(n) over w as tn, coalesce(sum(case when bin={BINS-1} then G0 end) over w,0) as mg,
 coalesce(sum(case when bin={BINS-1} then H0 end) over w,0) as mh, coalesce(sum(case when bin={BINS-1} then n end) over w,0) as mn from hist window w as (partition by node, f)),
 l as (select *, sum(G0) over w as lg, sum(H0) over w as lh, sum(n) over w as ln from t where bin < {BINS-1} window w as (partition by node, f order by bin)),
 s as (select node, f, bin, nl as nan_left, lg+nl*mg as ag, lh+nl*mh as ah, ln+nl*mn as an, tg, th, tn from l, (values (0),(1)) x(nl) where mn > 0 or nl = 1),
 cuts as (select node, f, bin, nan_left, 0.5*(ag*ag/(ah+1.0+1e-8) + (tg-ag)*(tg-ag)/(th-ah+1.0+1e-8) - tg*tg/(th+1.0+1e-8)) as gain, an::bigint as n_left, (tn-an)::bigint as n_right from s where an >= 10 and tn-an >= 10)"""


@query(SCAN + " select node, f, bin, nan_left, round(gain,4) as gain, n_left, n_right from cuts")
def split_gains(spark, sf):
    return splits.scan(splits.histogram(graded(spark, sf), CODES, 1), 1, BINS).withColumn("gain", r("gain", 4))


@query(SCAN + " select node, f, bin, nan_left, round(gain,4) as gain, n_left, n_right from cuts qualify row_number() over (partition by node order by gain desc, f, bin, nan_left desc) = 1")
def best_axis_split(spark, sf):
    return splits.best(splits.scan(splits.histogram(graded(spark, sf), CODES, 1), 1, BINS)).withColumn("gain", r("gain", 4))


@query(G + " select node, sum(g0) as G0, sum(h0) as H0, count(*) as n, round(sum(0.5*g0*g0/(h0+1.0+1e-8)),4) as bound from g group by node")
def node_totals(spark, sf):
    return splits.totals(graded(spark, sf), 1).withColumn("bound", r("bound", 4))


@query(G + " select node, round(-G0/(H0+1.0+1e-8),8) as leaf0 from (select node, sum(g0) as G0, sum(h0) as H0 from g group by node)")
def leaf_values(spark, sf):
    return splits.leaf_values(splits.totals(graded(spark, sf), 1), 1).select("node", r("leaf0", 8).alias("leaf0"))


@query(SCORED + ", a as (select y as node, sum(abs(p0-(c3=0)::int)) as a0, sum(abs(p1-(c3=1)::int)) as a1, sum(abs(p2-(c3=2)::int)) as a2 from p group by y) select node, case when a0>=a1 and a0>=a2 then 0 when a1>=a2 then 1 else 2 end as dominant from a")
def dominant_class(spark, sf):
    g, h = gradients.softmax_gradients([F.col(f"f{i}") for i in range(3)], F.col("c3"))
    return splits.dominant_class(scored3(spark, sf).select(F.col("y").alias("node"), *[v.alias(f"g{i}") for i, v in enumerate(g)]), 3)


@query(V + ", g as (select *, 0.5::double-y as g0, 0.25::double as h0 from v) " + " union all ".join(f"select 0 as node, {i} as f, round(sum({c}*g0),4) as xg, round(abs(sum({c}*g0))/sqrt(sum(h0*{c}*{c})+1.0+1e-8),5) as sis from g" for i, c in enumerate(COLS)))
def sis_scores(spark, sf):
    g = base(spark, sf).withColumns({"g0": 0.5 - F.col("y"), "h0": F.lit(0.25), "node": F.lit(0)})
    return splits.sis_scores(g, COLS, "g0", "h0").withColumns({"xg": r("xg", 4), "sis": r("sis", 5)})


DIRECTIONS = [[0.0010917, 1.0, -0.6123418], [0.02, 0.0, 1.0], [1.0, 0.0, 0.0]]
PROJECTED = V + ", g as (select *, 0.5::double-y as g0, 0.25::double as h0 from v), pr as (" + " union all ".join(f"select {d} as dir, {' + '.join(f'{c}*{w}::double' for w, c in zip(ws, COLS) if w)} as p, g0, h0, y from g" for d, ws in enumerate(DIRECTIONS)) + ")"


def projected(spark, sf) -> DataFrame:
    g = base(spark, sf).withColumns({"g0": 0.5 - F.col("y"), "h0": F.lit(0.25), "node": F.lit(0)})
    return splits.project_all(g, DIRECTIONS, COLS, ["node", "g0", "h0", "y"])


@query(PROJECTED + " select dir, round(min(p),6) as lo, round(max(p),6) as hi, round(sum(p),3) as total, count(*) as n from pr group by dir")
def oblique_projection(spark, sf):
    return projected(spark, sf).groupBy("dir").agg(r(F.min("p")).alias("lo"), r(F.max("p")).alias("hi"), r(F.sum("p"), 3).alias("total"), F.count("*").alias("n"))


OB = PROJECTED + """, rg as (select dir, min(p) as lo, max(p) as hi from pr group by dir),
oh as (select dir, least(63, floor((p-lo)/(hi-lo+1e-8::double)*64))::int as bin, sum(g0) as G0, sum(h0) as H0, count(*) as n from pr join rg using (dir) group by all)"""


@query(OB + " select dir, bin, G0, H0, n from oh")
def oblique_histogram(spark, sf):
    return splits.oblique_histogram(projected(spark, sf), 1).select("dir", "bin", "G0", "H0", "n")


@query(OB + """, t as (select *, sum(G0) over (partition by dir) as tg, sum(H0) over (partition by dir) as th, sum(n) over (partition by dir) as tn, sum(G0) over w as lg, sum(H0) over w as lh, sum(n) over w as ln from oh window w as (partition by dir order by bin)),
c as (select dir, bin, 0.5*(lg*lg/(lh+1.0+1e-8)+(tg-lg)*(tg-lg)/(th-lh+1.0+1e-8)-tg*tg/(th+1.0+1e-8)) as gain, ln::bigint as n_left, (tn-ln)::bigint as n_right from t where ln >= 10 and tn-ln >= 10)
select dir, bin, round(gain,4) as gain, n_left, n_right from c order by gain desc, dir, bin limit 1""")
def best_oblique_split(spark, sf):
    cuts = splits.scan(splits.oblique_histogram(projected(spark, sf), 1), 1, 65, key="dir")
    return splits.best(cuts, key="dir").select("dir", "bin", r("gain", 4).alias("gain"), "n_left", "n_right")


LEFT = "0.0010917::double*x0 + x1 - 0.6123418::double*x2 < 0.0535::double"


@query(G + f", s as (select node, sum(case when {LEFT} then g0 else 0 end) as lg, sum(case when {LEFT} then h0 else 0 end) as lh, sum(g0) as tg, sum(h0) as th, count(*) filter (where {LEFT}) as n_left, count(*) as n from g where x0 is not null and x1 is not null and x2 is not null group by node) select node, round(0.5*(lg*lg/(lh+1.0+1e-8)+(tg-lg)*(tg-lg)/(th-lh+1.0+1e-8)-tg*tg/(th+1.0+1e-8)),4) as gain, n_left, n-n_left as n_right from s")
def exact_oblique_gain(spark, sf):
    left = splits.project([0.0010917, 1.0, -0.6123418], COLS) < 0.0535
    return splits.exact_gain(graded(spark, sf).na.drop(subset=COLS), left, 1).withColumn("gain", r("gain", 4))


@query(V + ", g as (select *, 0.5::double-y as g0, 0.25::double as h0 from v) " + " union all ".join([f"select {i} as i, {j} as j, round(sum(h0*{COLS[i]}*{COLS[j]}),1) as v from g" for i in range(3) for j in range(i, 3)] + [f"select {i}, -1, round(sum({c}*g0),1) from g" for i, c in enumerate(COLS)]))
def gram_matrix(spark, sf):
    g = base(spark, sf).withColumns({"g0": 0.5 - F.col("y"), "h0": F.lit(0.25)})
    return splits.gram(g, COLS, "g0", "h0").withColumn("v", r("v", 1))


@query(M + f", n as (select case when x0 is null then 1 when x0 < 25 then 1 else 2 end as node, y, x1, x2 from m), d as (select case when node = 1 then (case when x1 is null or x1 < 0.05 then 3 else 4 end) else (case when x2 is null then 6 when x2 < 0.04 then 5 else 6 end) end as node, y from n) select node, y, count(*) as n from d group by all")
def route_tree(spark, sf):
    from slantree.plans.trees import Node, goes_left

    m, none = missing(spark, sf), [0.0] * 3
    nodes = {0: Node(0, [], [1.0, 0, 0], 25.0, True), 1: Node(1, [], [0, 1.0, 0], 0.05, True), 2: Node(2, [], [0, 0, 1.0], 0.04, False)}
    side = F.when(goes_left(nodes[0], COLS, none), F.when(goes_left(nodes[1], COLS, none), 3).otherwise(4)).otherwise(F.when(goes_left(nodes[2], COLS, none), 5).otherwise(6))
    return m.select(side.alias("node"), "y").groupBy("node", "y").agg(F.count("*").alias("n"))


# --- metrics --------------------------------------------------------------------------------------

PRED = V + ", p as (select y, 1/(1+exp(-(0.05*(x0-25.5) + 20*(x1-0.05)))) as score, (0.05*(x0-25.5) + 20*(x1-0.05) > 0)::int as pred, x0, price from v)"


def predicted(spark, sf) -> DataFrame:
    z = 0.05 * (F.col("x0") - 25.5) + 20 * (F.col("x1") - 0.05)
    return base(spark, sf).select("y", (1 / (1 + F.exp(-z))).alias("score"), (z > 0).cast("int").alias("pred"), "x0", "price")


@query(PRED + " select y, pred, count(*) as n from p group by all")
def confusion_matrix(spark, sf):
    return metrics.confusion(predicted(spark, sf))


@query(PRED + """, c as (select k, count(*) filter (where y=k) as s, count(*) filter (where pred=k) as q, count(*) filter (where y=k and pred=k) as tp, count(*) as n from p, (values (0),(1)) x(k) group by k)
select round(sum(tp)/max(n),6) as accuracy, round(avg(tp/s),6) as balanced_accuracy, round(avg(((n-s)-(q-tp))/(n-s)),6) as specificity_macro, round(avg(2*tp/(s+q)),6) as f1_macro, round(sum(2*tp/(s+q)*s)/sum(s),6) as f1_weighted from c""")
def classification_summary(spark, sf):
    s = metrics.summary(predicted(spark, sf))
    return s.select(*[r(c).alias(c) for c in s.columns])


@query(PRED + ", d as (select round(score,4) as s, sum(y) as p, sum(1-y) as q from p group by 1), w as (select *, coalesce(sum(q) over (order by s rows between unbounded preceding and 1 preceding),0) as lower from d) select round(sum(p*(lower+q/2.0))/(sum(p)*sum(q)),6) as roc_auc from w")
def roc_auc(spark, sf):
    return metrics.roc_auc(predicted(spark, sf).withColumn("score", F.round("score", 4))).select(r("roc_auc").alias("roc_auc"))


@query(PRED + ", d as (select round(score,4) as s, sum(y) as p, count(*) as n from p group by 1), w as (select *, sum(p) over (order by s desc)/sum(n) over (order by s desc) as prec from d) select round(sum(p*prec)/sum(p),6) as average_precision from w")
def average_precision(spark, sf):
    return metrics.average_precision(predicted(spark, sf).withColumn("score", F.round("score", 4))).select(r("average_precision").alias("average_precision"))


@query(PRED + " select round(avg(case when y=1 then -ln(score) else -ln(1-score) end),6) as log_loss from p")
def log_loss(spark, sf):
    return metrics.log_loss(predicted(spark, sf), "y", "score").select(r("log_loss").alias("log_loss"))


@query(PRED + " select round(avg((price-38000)*(price-38000)),1) as mse, round(avg(abs(price-38000)),4) as mae, round(avg(case when abs(price-38000)<=1000 then 0.5*(price-38000)*(price-38000) else 1000*(abs(price-38000)-500) end),2) as huber from p")
def regression_losses(spark, sf):
    e = F.col("price") - 38000
    return predicted(spark, sf).agg(r(F.avg(e * e), 1).alias("mse"), r(F.avg(F.abs(e)), 4).alias("mae"), r(F.avg(gradients.huber_loss(F.lit(38000.0), F.col("price"), 1000.0)), 2).alias("huber"))


@query(PRED + ", a as (select x0, count(*) as n from p group by 1), ra as (select x0, sum(n) over (order by x0) - (n-1)/2.0 as r from a), b as (select score, count(*) as n from (select round(score,3) as score from p) group by 1), rb as (select score, sum(n) over (order by score) - (n-1)/2.0 as r from b) select round(corr(p.x0, round(p.score,3)),6) as pearson, round(corr(ra.r, rb.r),6) as spearman from p join ra using (x0) join rb on round(p.score,3) = rb.score")
def correlations(spark, sf):
    c = metrics.correlations(predicted(spark, sf).withColumn("score", F.round("score", 3)), "x0", "score")
    return c.select(r("pearson").alias("pearson"), r("spearman").alias("spearman"))


# --- model analysis -------------------------------------------------------------------------------

REC = """with r as (select l_orderkey::bigint * 1000 + row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) - 1 as tree_id, (l_linenumber - 1)::int as node_id, l_partkey, l_quantity::double as x0, l_discount::double as x1, l_tax::double as x2, l_returnflag as cat, l_extendedprice::double as price from lineitem),
rec as (select tree_id, node_id, case when node_id = 0 then 0 when node_id < 3 then 1 else 2 end as depth, [x0 - 25.25, case when l_partkey % 3 = 0 then 0 else 100*x1 + 1 end, case when l_partkey % 5 = 0 then 0 else 100*x2 + 1 end] as w, price/1e4 as gain, cat as family from r),
n as (select *, sqrt(list_sum(list_transform(w, lambda x: x*x))) as nw from rec),
pair as (select c.tree_id, c.node_id, c.depth, c.w, p.w as pw, degrees(acos(least(1.0, abs(c.w[1]*p.w[1]+c.w[2]*p.w[2]+c.w[3]*p.w[3])/(c.nw*p.nw)))) as deg from n c join n p on c.tree_id = p.tree_id and c.node_id > 0 and p.node_id = (c.node_id-1)//2)"""


def records(spark, sf, *keep: str) -> DataFrame:
    """Split records made from all lineitem rows: an order is a tree (several, where a line number repeats), its lines are nodes, with three weights.

    Orders are dealt into as many parts as the rows ask for.  `keep` names columns of
    lineitem to keep: groups that include l_orderkey need no further shuffle.
    """
    from pyspark.sql.window import Window as W

    copy = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice"))
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    li = li.repartition(ordered.parts_for(li), "l_orderkey").withColumn("copy", copy)
    w = F.expr("array(l_quantity - 25.25D, if(l_partkey % 3 = 0, 0D, 100*l_discount + 1), if(l_partkey % 5 = 0, 0D, 100*l_tax + 1))")
    node = (F.col("l_linenumber") - 1).cast("int")
    return li.select((F.col("l_orderkey").cast("long") * 1000 + F.col("copy") - 1).alias("tree_id"), node.alias("node_id"), F.when(node == 0, 0).when(node < 3, 1).otherwise(2).alias("depth"), w.alias("w"), (F.col("l_extendedprice") / 1e4).alias("gain"), F.col("l_returnflag").alias("family"), *keep)


@query(REC + ", d as (select degrees(acos(least(1.0, list_max(list_transform(w, lambda x: abs(x)))/nw))) as deg from n) select round(avg(deg),5) as mean_deg, round(median(deg),5) as median_deg, round(avg((deg>10)::int),6) as over_10, round(avg((deg>30)::int),6) as over_30, (select round(avg((len(list_filter(w, lambda x: x <> 0)) > 1)::int),6) from rec) as win_rate from d")
def obliqueness_profile(spark, sf):
    p = analysis.obliqueness_profile(records(spark, sf))
    return p.select(r("mean_deg", 5).alias("mean_deg"), r("median_deg", 5).alias("median_deg"), r("over_10").alias("over_10"), r("over_30").alias("over_30"), r("win_rate").alias("win_rate"))


@query(REC + " select depth, round(avg(deg),5) as drift_deg, count(*) as n from pair group by depth")
def parent_drift(spark, sf):
    return analysis.drift(records(spark, sf)).withColumn("drift_deg", r("drift_deg", 5))


@query(REC + ", e as (select gain, list_sum(list_transform(w, lambda x: abs(x))) as size, unnest([0,1,2]) as f, unnest(w) as v from rec), s as (select f, sum(abs(v)/size*gain) as g, sum(abs(v)) as m, count(*) as c from e where v <> 0 group by f) select f, round(g/sum(g) over (),6) as by_gain, round(m/sum(m) over (),6) as by_magnitude, round(c/sum(c) over (),6) as by_frequency from s")
def feature_importance(spark, sf):
    i = analysis.importance(records(spark, sf))
    return i.select("f", r("by_gain").alias("by_gain"), r("by_magnitude").alias("by_magnitude"), r("by_frequency").alias("by_frequency"))


@query(REC + ", e as (select unnest([0,1,2]) as f, unnest(w) as v from rec), c as (select count(*) as c from e where v <> 0 group by f), p as (select c/sum(c) over () as p from c) select round(-sum(p*ln(p))/ln(3.0),6) as entropy from p")
def usage_entropy(spark, sf):
    return analysis.usage_entropy(records(spark, sf), 3).select(r("entropy").alias("entropy"))


@query(REC + ", s as (select depth, deg, list_filter([1,2,3], lambda i: w[i] <> 0) as a, list_filter([1,2,3], lambda i: pw[i] <> 0) as b from pair) select depth, round(avg(len(list_intersect(a,b))/len(list_distinct(list_concat(a,b)))),6) as jaccard, round(avg(deg),5) as deg from s group by depth")
def support_jaccard(spark, sf):
    return analysis.support_jaccard(records(spark, sf)).withColumns({"jaccard": r("jaccard"), "deg": r("deg", 5)})


@query(REC + " select a.tree_id, round(avg(abs(a.w[1]*b.w[1]+a.w[2]*b.w[2]+a.w[3]*b.w[3])/(a.nw*b.nw)),6) as coherence from n a join n b on a.tree_id = b.tree_id and a.node_id < b.node_id group by 1")
def within_tree_coherence(spark, sf):
    return analysis.coherence(records(spark, sf)).withColumn("coherence", r("coherence"))


@query(REC + ", s as (select least(3, floor(tree_id*4/(select max(tree_id)+1 from rec)))::int as part, family, count(*) as n, sum(gain) as gain from rec group by all) select part, family, round(n/sum(n) over (partition by part),6) as win_share, round(gain/sum(gain) over (partition by part),6) as gain_share from s")
def family_share(spark, sf):
    rec = records(spark, sf)
    return analysis.family_share(rec, rec.agg(F.max("tree_id")).first()[0] + 1).withColumns({"win_share": r("win_share"), "gain_share": r("gain_share")})


@query(REC + " select depth, family, round(avg(gain),5) as mean_gain, round(max(gain),5) as top_gain, count(*) as n from rec group by all")
def gain_by_depth(spark, sf):
    return analysis.gain_by_depth(records(spark, sf)).withColumns({"mean_gain": r("mean_gain", 5), "top_gain": r("top_gain", 5)})


# --- benchmark tables -----------------------------------------------------------------------------


@query("select (user_id % 6)::int as dataset, event_type as model, round(avg(value),5) as mean, round(stddev_samp(value),5) as std, count(*) as n from events group by all")
def benchmark_summary(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 6).cast("int").alias("dataset"), F.col("event_type").alias("model"), "value")
    return analysis.summary(e, ["dataset", "model"], "value").withColumns({"mean": r("mean", 5), "std": r("std", 5)})


@query("with s as (select (user_id % 6)::int as dataset, event_type as model, avg(value) as a, max(value) as b from events group by all), q as (select dataset, model, a from s), c as (select dataset, model, b from s) select dataset, model, round(a,5) as quality, round(b,5) as cost from q join c using (dataset, model)")
def performance_vs_cost(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("dataset", (F.col("user_id") % 6).cast("int")).withColumnRenamed("event_type", "model")
    quality = e.groupBy("dataset", "model").agg(r(F.avg("value"), 5).alias("quality"))
    return analysis.quality_and_cost(quality, e.groupBy("dataset", "model").agg(r(F.max("value"), 5).alias("cost")))


@query()
def oblique_classifier(spark, sf):
    """Two rounds of four leaves; predictions against labels."""
    from slantree.plans.boost import ObliqueBoostClassifier

    d = base(spark, sf).select("k", *COLS, "y")
    model = ObliqueBoostClassifier(featuresCols=COLS, rounds=2, maxDepth=2, learningRate=0.3, goss=False, subsample=1.0, maxBin=64, directions=8).fit(d)
    return model.transform(d).groupBy("y", "prediction").agg(F.count("*").alias("n"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return best_axis_split(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from slantree import entries_model, entries_studies, entries_trees  # noqa: F401  (register their queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from slantree import entries_model, entries_studies, entries_trees  # noqa: F401

    return dict(SQL)
