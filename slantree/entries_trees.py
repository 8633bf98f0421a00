"""Queries that fit trees, each with SQL that grows the same tree."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantree.entries import COLS, V, base, query, r
from slantree.plans.boost import ObliqueBoostRegressor
from slantree.plans.shapes import exact_tree, oblivious_tree

#: A target whose large values stand in one corner, so that the best node is often a deep one.
TARGET = "exp(x0 / 4) + 40 * x1 * x0 + 300 * x2"
#: One that an oblique cut fits better than any axis one.
SLOPED = "x0 * x0 + 9000 * x1 - 7000 * x2"
FIT_BINS = 16


def target(spark, sf, of: str = TARGET) -> DataFrame:
    return base(spark, sf).select(*COLS, F.expr(of).alias("t"))


def regressor(**more) -> ObliqueBoostRegressor:
    plain = {"rounds": 1, "learningRate": 0.5, "maxBin": FIT_BINS, "directions": 0, "goss": False, "subsample": 1.0}
    return ObliqueBoostRegressor(featuresCols=COLS, labelCol="t", **(plain | more))


def _names(form: str, sep: str = ", ") -> str:
    return sep.join(form.format(i=i) for i in range(3))


def _levels_sql(levels: int, covariance: bool = False, of: str = TARGET) -> str:
    """Best cuts of all nodes of the first levels: b0, b1, .. (node, f, bin, gain, threshold); f = 3 is the covariance direction."""
    b = FIT_BINS
    wide = _names("(hi{i} - lo{i} + 1e-8::double) as wide{i}")
    sql = f"""{V}, src as (select x0, x1, x2, {re.sub(r"(?<![a-z])([0-9]+)", r"\1.0::double", of)} as t from v),
st as (select *, {wide} from (select {_names("min(x{i}) as lo{i}, max(x{i}) as hi{i}, sum(x{i}) / (count(*) + 1e-8::double) as m{i}")}, avg(t) as init from src)),
r0 as (select 0 as node, x0, x1, x2, init - t as g, {_names(f"least({b - 2}, greatest(0, floor((x{{i}} - lo{{i}}) * ({b - 1} / wide{{i}}))))::int as c{{i}}")} from src, st)"""
    for n in range(levels):
        hists = [f"select node, {i} as f, c{i} as bin, sum(g) as g, count(*) as n from r{n} group by all" for i in range(3)]
        if covariance:
            sql += f""", a{n} as (select node, {_names(f"sum((x{{i}} - m{{i}}) / wide{{i}} * g) as a{{i}}")} from r{n}, st group by node),
w{n} as (select node, {_names("-a{i} / sqrt(a0*a0 + a1*a1 + a2*a2) / wide{i} as w{i}")} from a{n}, st),
e{n} as (select *, {_names("least(w{i} * lo{i}, w{i} * hi{i})", " + ")} as plo, {_names("greatest(w{i} * lo{i}, w{i} * hi{i})", " + ")} as phi from w{n}, st),
p{n} as (select q.*, least({b - 2}, greatest(0, floor(({_names("x{i} * w{i}", " + ")} - plo) * ({b - 1} / (phi - plo + 1e-8::double)))))::int as c3 from r{n} q join e{n} using (node))"""
            hists.append(f"select node, 3 as f, c3 as bin, sum(g) as g, count(*) as n from p{n} group by all")
        edge = "case f " + " ".join(f"when {i} then (select lo{i} + (bin + 1) * wide{i} / {b - 1} from st)" for i in range(3)) + " end"
        thresholds = f"case when f = 3 then (select plo + (bin + 1) * (phi - plo + 1e-8::double) / {b - 1} from e{n} where e{n}.node = k{n}.node) else {edge} end" if covariance else edge
        sql += f""", h{n} as ({" union all ".join(hists)}),
s{n} as (select *, sum(g) over (partition by node, f order by bin) as lg, sum(n) over (partition by node, f order by bin) as ln, sum(g) over (partition by node, f) as tg, sum(n) over (partition by node, f) as tn from h{n}),
k{n} as (select node, f, bin, ln, tn - ln as rn, lg, tg, tn, 0.5 * (lg * lg / (ln + 1 + 1e-8::double) + (tg - lg) * (tg - lg) / (tn - ln + 1 + 1e-8::double) - tg * tg / (tn + 1 + 1e-8::double)) as gain from s{n} where ln >= 10 and tn - ln >= 10),
b{n} as (select node, f, bin, gain, lg, ln, tg, tn, {thresholds} as threshold from k{n} where gain > 0 qualify row_number() over (partition by node order by gain desc, f, bin) = 1)"""
        if n + 1 < levels:
            source = f"p{n}" if covariance else f"r{n}"
            code = "case f when 0 then c0 when 1 then c1 when 2 then c2 " + ("else c3 end" if covariance else "end")
            sql += f", r{n + 1} as (select case when {code} <= bin then 2 * node + 1 else 2 * node + 2 end as node, x0, x1, x2, g, c0, c1, c2 from {source} join b{n} using (node))"
    return sql + ", splits as (" + " union all ".join(f"select * from b{n}" for n in range(levels)) + ")"


def _best_first_sql(leaves: int) -> str:
    """Nodes split one after the other, always the one of largest gain."""
    sql, so_far = ", o1 as (select node from splits where node = 0)", "select node from o1"
    for k in range(2, leaves):
        sql += f", o{k} as (select node from splits where node > 0 and (node - 1) // 2 in ({so_far}) and node not in ({so_far}) order by gain desc, node limit 1)"
        so_far += f" union all select node from o{k}"
    return sql + f", kept as (select * from splits where node in ({so_far}))"


def split_rows(model, spark) -> DataFrame:
    s = model.split_records(spark)
    f = F.when(F.col("family") == "axis", F.array_position("w", 1.0) - 1).otherwise(3).cast("int")
    return s.select(F.col("node_id").alias("node"), f.alias("f"), r("threshold", 5).alias("threshold"), r("gain", 2).alias("gain"))


SPLIT_ROWS = " select node, f, round(threshold, 5) as threshold, round(gain, 2) as gain from kept"


@query(_levels_sql(4) + _best_first_sql(5) + SPLIT_ROWS)
def best_first_tree(spark, sf):
    """Five leaves, always splitting the node of largest gain; filling level by level gives another tree here."""
    return split_rows(regressor(maxLeaves=5).fit(target(spark, sf)), spark)


@query(_levels_sql(2, True, SLOPED) + ", kept as (select * from splits)" + SPLIT_ROWS)
def covariance_tree(spark, sf):
    """Two levels whose nodes choose between axis cuts and the direction -X'g over all their rows."""
    return split_rows(regressor(maxDepth=1, maxLeaves=4, exactDirections=["covariance"]).fit(target(spark, sf, SLOPED)), spark)


@query(
    _levels_sql(1)
    + """, root as (select -tg / (tn + 1 + 1e-8) as up, * from b0),
leaf as (select 1 as node, (ln * (-lg / (ln + 1 + 1e-8)) + up) / (ln + 1 + 1e-8) as v from root union all select 2, ((tn - ln) * (-(tg - lg) / (tn - ln + 1 + 1e-8)) + up) / (tn - ln + 1 + 1e-8) from root),
sides as (select case when (case f when 0 then c0 when 1 then c1 else c2 end) <= bin then 1 else 2 end as node from r0, root)
select round(init + 0.5 * v, 5) as prediction, count(*) as n from sides join leaf using (node), st group by 1"""
)
def regressor_stump(spark, sf):
    """One round of two leaves, drawn towards the root's value."""
    t = target(spark, sf)
    return regressor(maxLeaves=2).fit(t).transform(t).groupBy(r("prediction", 5).alias("prediction")).agg(F.count("*").alias("n"))


def _exact_sql() -> str:
    sql = f"{V}, src as (select x0, x1, x2, y, 0.5::double - y as g0 from v), r0 as (select 0 as node, * from src)"
    for n in range(2):
        sql += f""", m{n} as ({" union all ".join(f"select node, {i} as f, x{i} as v, sum(g0) as g, 0.25::double * count(*) as h, count(*) as n from r{n} group by all" for i in range(3))}),
u{n} as (select *, sum(g) over w as rg, sum(h) over w as rh, sum(n) over w as rn, lead(v) over w as nv, sum(g) over p as tg, sum(h) over p as th, sum(n) over p as tn from m{n} window w as (partition by node, f order by v), p as (partition by node, f)),
k{n} as (select node, f, v, (v + nv) / 2 as threshold, 0.5 * (rg*rg/(rh + 1 + 1e-8::double) + (tg-rg)*(tg-rg)/(th-rh + 1 + 1e-8::double) - tg*tg/(th + 1 + 1e-8::double)) as gain from u{n}
  where tn >= 4 and rn < tn and floor(rn / greatest(1, floor(tn / 64))) > floor((rn - n) / greatest(1, floor(tn / 64))) and rh >= 0.1 and th - rh >= 0.1),
b{n} as (select node, f, threshold, gain from k{n} where gain > 0 qualify row_number() over (partition by node order by gain desc, f, v) = 1),
r{n + 1} as (select case when b{n}.node is null then q.node when (case f when 0 then x0 when 1 then x1 else x2 end) < threshold then 2 * q.node + 1 else 2 * q.node + 2 end as node, x0, x1, x2, y, g0 from r{n} q left join b{n} on q.node = b{n}.node)"""
    return sql


EXACT = _exact_sql()


@query(EXACT + " select node, round(threshold, 6) as threshold, f, round(gain, 4) as gain, null::double as leaf from (select * from b0 union all select * from b1) union all select node, null, null, null, round(-sum(g0) / (0.25 * count(*) + 1 + 1e-8), 8) from r2 group by node")
def exact_threshold_tree(spark, sf):
    """Depth two, cuts between sorted values, leaves that are not drawn towards their parent's."""
    rows = base(spark, sf).select(*COLS, (F.lit(0.5) - F.col("y")).alias("g0"), F.lit(0.25).alias("h0"))
    nodes = exact_tree(rows, COLS, 2).nodes.values()
    out = [(n.id, None, None, None, round(n.leaf[0], 8)) if n.is_leaf else (n.id, round(n.threshold, 6), n.w.index(1.0), round(n.gain, 4), None) for n in nodes]
    return spark.createDataFrame(out, "node int, threshold double, f int, gain double, leaf double")


SHARED = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0011, 1.0, -0.6]]


def _dirs_sql(i: int) -> str:
    return " + ".join(f"x{j} * {w}::double" for j, w in enumerate(SHARED[i]) if w)


def _oblivious_sql(depth: int, shared: bool) -> str:
    sql = f"{V}, r0 as (select 0 as node, y, 0.5::double - y as g0, {', '.join(f'{_dirs_sql(i)} as p{i}' for i in range(3))} from v)"
    for n in range(depth):
        rows = " union all ".join(f"select node, {i} as dir, p{i} as p, g0 from r{n}" for i in range(3))
        if shared:
            sql += f""", m{n} as ({rows}), q{n} as (select dir, quantile_cont(p, [{", ".join(f"{k / 20}" for k in range(1, 20))}]) as edges from m{n} group by dir), z{n} as (select dir, unnest(range(1, 20)) as k, unnest(edges) as edge from q{n}),
g{n} as (select node, dir, k, edge, sum(g0) as tg, count(*) as tn, coalesce(sum(g0) filter (p < edge), 0) as lg, count(*) filter (p < edge) as ln from m{n} join z{n} using (dir) group by all),
c{n} as (select dir, k, edge, sum(case when ln >= 4 and tn - ln >= 4 then 0.5 * (lg*lg/(0.25*ln + 1 + 1e-8::double) + (tg-lg)*(tg-lg)/(0.25*(tn-ln) + 1 + 1e-8::double) - tg*tg/(0.25*tn + 1 + 1e-8::double)) else 0 end) as gain from g{n} group by dir, k, edge),
d{n} as (select dir, edge from c{n} order by gain desc, dir, k limit 1),
r{n + 1} as (select node * 2 + ((case dir when 0 then p0 when 1 then p1 else p2 end) >= edge)::int as node, y, g0, p0, p1, p2 from r{n}, d{n})"""
        else:
            sql += f""", m{n} as ({rows}), z{n} as (select node, dir, min(p) as lo, max(p) as hi, count(*) as rows from m{n} group by node, dir),
h{n} as (select node, dir, lo, hi, least(31, floor((p - lo) / (hi - lo + 1e-8::double) * 32))::int as bin, sum(g0) as g, count(*) as n from m{n} join z{n} using (node, dir) where rows >= 8 group by all),
s{n} as (select *, sum(g) over w as lg, sum(n) over w as ln, sum(g) over p as tg, sum(n) over p as tn from h{n} window w as (partition by node, dir order by bin), p as (partition by node, dir)),
k{n} as (select node, dir, bin, lo + (bin + 1) * (hi - lo + 1e-8::double) / 32 as edge, 0.5 * (lg*lg/(0.25*ln + 1 + 1e-8::double) + (tg-lg)*(tg-lg)/(0.25*(tn-ln) + 1 + 1e-8::double) - tg*tg/(0.25*tn + 1 + 1e-8::double)) as gain from s{n} where ln >= 1 and tn - ln >= 1),
t{n} as (select * from k{n} where gain > 0 qualify row_number() over (partition by node, dir order by gain desc, bin) = 1),
d{n} as (select coalesce((select dir from t{n} group by dir order by sum(gain) desc, dir limit 1), 0) as dir),
r{n + 1} as (select q.node * 2 + coalesce((case d{n}.dir when 0 then p0 when 1 then p1 else p2 end) >= edge, false)::int as node, y, g0, p0, p1, p2 from r{n} q cross join d{n} left join t{n} on t{n}.node = q.node and t{n}.dir = d{n}.dir)"""
    return sql + f" select node as code, count(*) as n, round(-sum(g0) / (0.25 * count(*) + 1 + 1e-8), 6) as score from r{depth} group by node"


def _oblivious(spark, sf, shared: bool) -> DataFrame:
    rows = base(spark, sf).select(*COLS, (F.lit(0.5) - F.col("y")).alias("g0"), F.lit(0.25).alias("h0"))
    tree = oblivious_tree(rows, COLS, SHARED, 3, shared, bins=32)
    return rows.groupBy(tree.code().alias("code"), r(tree.score()).alias("score")).agg(F.count("*").alias("n"))


@query(_oblivious_sql(3, False))
def oblivious_tree_leaves(spark, sf):
    """Three levels, one direction each, a threshold per node: rows and scores by leaf."""
    return _oblivious(spark, sf, False)


@query(_oblivious_sql(3, True))
def fully_oblivious_tree_leaves(spark, sf):
    """Three levels of one direction and one threshold each: rows and scores by leaf."""
    return _oblivious(spark, sf, True)
