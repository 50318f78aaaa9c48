"""Queries of nested selection, ensembles, final fits, controls and stratified bootstrap."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import artifact, nested, trees
from spanforge.operators.audit import grouped_folds
from spanforge.sources.shared import once, shared_folder

from .evaluation import query, rounded
from .views import load

#: Orders as rows to predict the logarithm of their price: by the number and mean quantity of their lines; groups are customers, the source is the priority.
_ROWS = """rows as (select o_orderkey as id, o_custkey as grp, o_orderpriority as source, round(ln(cast(o_totalprice as double)), 9) as y, coalesce(a, 0) as a, coalesce(b, 0) as b
    from orders left join (select l_orderkey, cast(count(*) as double) as a, round(avg(cast(l_quantity as double)), 9) as b from lineitem group by l_orderkey) on l_orderkey = o_orderkey),
    fg as (select grp, ntile(5) over (order by sha256('3|' || grp), grp) as fold from (select distinct grp from rows)), fr as (select rows.*, fold from rows join fg using (grp))"""
#: Ridge on two standardised features from sums n, sy, sa, sb, saa, sab, sbb, say, sby and a strength al, solved by Cramer's rule.
_SOLVE = """m as (select *, sa / n as ma, sb / n as mb, sy / n as my from t), v as (select *, saa - n * ma * ma as caa, sab - n * ma * mb as cab, sbb - n * mb * mb as cbb, say - sa * my as cay, sby - sb * my as cby from m),
    z as (select *, sqrt(caa / n) as da, sqrt(cbb / n) as db from v), w as (select *, caa / (da * da) + al as zaa, cab / (da * db) as zab, cbb / (db * db) + al as zbb, cay / da as za, cby / db as zb from z),
    f as (select *, (za * zbb - zb * zab) / (zaa * zbb - zab * zab) / da as ca, (zb * zaa - za * zab) / (zaa * zbb - zab * zab) / db as cb from w)"""
_SUMS = "count(*)::double as n, sum(y) as sy, sum(a) as sa, sum(b) as sb, sum(a * a) as saa, sum(a * b) as sab, sum(b * b) as sbb, sum(a * y) as say, sum(b * y) as sby"
FEATURES = ["a", "b"]


def price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("a"), F.round(F.avg(F.col("l_quantity").cast("double")), 9).alias("b"))
    return once(o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), F.col("o_orderpriority").alias("source"), F.round(F.log(F.col("o_totalprice").cast("double")), 9).alias("y"),
        F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")), "prices")


@query(f"""with {_ROWS}, t as (select fold, al, (select count(*) from fr x where x.fold <> g.fold)::double as n, sums.* exclude (n) from (select distinct fold from fr) g, (select unnest([1.0, 100.0]) as al),
        lateral (select {_SUMS} from fr x where x.fold <> g.fold) sums), {_SOLVE}
    select id, fr.fold, al as alpha, round(my - ca * ma - cb * mb + ca * fr.a + cb * fr.b, 5) as prediction from fr join f on f.fold = fr.fold""")
def k6_ridge_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped_folds(price_rows(spark, sf_dir), "grp", 5, 3)
    return rounded(nested.out_of_fold(rows, "fold", "y", FEATURES, [1.0, 100.0]).select("id", "fold", "alpha", "prediction"), 5)


_DRAW = lambda kind, i: f"('0x' || substr(md5('7|{kind}|' || held || '|' || tree || '|' || node || '|{i}'), 1, 8))::bigint / 4294967296.0"
_GAIN = lambda i: f"case when n{i} between 5 and n - 5 then round(s{i} * s{i} / n{i} + (s - s{i}) * (s - s{i}) / (n - n{i}) - s * s / n, 9) end"


def _level(k: int) -> str:
    """One level of all trees in SQL: ranges, cuts, sums, and the rows of both sides; of two features each node draws one."""
    return f"""r{k} as (select held, tree, node, min(a) as la, max(a) as ha, min(b) as lb, max(b) as hb from s{k} where train and open group by all),
    c{k} as (select held, tree, node, round(la + {_DRAW('cut', 0)} * (ha - la), 9) as ca, round(lb + {_DRAW('cut', 1)} * (hb - lb), 9) as cb, {_DRAW('pick', 0)} <= {_DRAW('pick', 1)} as first from r{k}),
    m{k} as (select held, tree, node, any_value(ca) as ca, any_value(cb) as cb, any_value(first) as first, count(*) as n, sum(y) as s, count(*) filter (a <= ca) as n0, coalesce(sum(y) filter (a <= ca), 0) as s0, count(*) filter (b <= cb) as n1, coalesce(sum(y) filter (b <= cb), 0) as s1
        from s{k} join c{k} using (held, tree, node) where train and open group by all),
    b{k} as (select held, tree, node, case when first then 0 else 1 end as feature, case when first then ca else cb end as cut from m{k} where case when first then {_GAIN(0)} else {_GAIN(1)} end > 0),
    s{k + 1} as (select held, tree, case when feature is null then node else 2 * node + (case when feature = 0 then a else b end > cut)::int end as node, open and feature is not null as open, train, id, fold, y, a, b from s{k} left join b{k} using (held, tree, node)),"""


@query(f"""with {_ROWS}, s0 as (select held, tree, 1::bigint as node, true as open, fold <> held as train, id, fold, y, a, b from fr, range(1, 6) h(held), range(12) t(tree)), {_level(0)} {_level(1)}
    v as (select held, tree, node, avg(y) as v from s2 where train group by all)
    select id, fold, round(avg(v), 5) as prediction from s2 join v using (held, tree, node) where not train group by id, fold""")
def k6_randomised_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped_folds(price_rows(spark, sf_dir), "grp", 5, 3)
    return rounded(trees.trees_out_of_fold(rows, "id", "fold", "y", FEATURES, trees=12, depth=2, min_leaf=5, seed=7), 5)


@query(f"""with {_ROWS}, t as (select g.source, 1.0 as al, sums.* from (select distinct source from rows) g, lateral (select {_SUMS} from rows x where x.source <> g.source) sums), {_SOLVE}
    select id, rows.source, round(my - ca * ma - cb * mb + ca * rows.a + cb * rows.b, 5) as prediction from rows join f on f.source = rows.source""")
def s11_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nested.out_of_fold(price_rows(spark, sf_dir), "source", "y", FEATURES, [1.0]).select("id", "source", "prediction"), 5)


@query(f"""with {_ROWS}, o as (select sum(y) as s, count(y) as n from fr), f as (select fold, sum(y) as s, count(y) as n from fr group by fold), p as (select source, sum(y) as s, count(y) as n from fr group by source), q as (select fold, source, sum(y) as s, count(y) as n from fr group by all)
    select id, round((o.s - f.s) / (o.n - f.n), 5) as constant, round(coalesce((p.s - q.s) / nullif(p.n - q.n, 0), (o.s - f.s) / (o.n - f.n)), 5) as by_source from fr join f using (fold) join p using (source) join q using (fold, source), o""")
def k8_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped_folds(price_rows(spark, sf_dir), "grp", 5, 3)
    a = nested.control_predictions(rows, "constant", "fold", "y", "source", "id").select("id", F.col("prediction").alias("constant"))
    b = nested.control_predictions(rows, "source", "fold", "y", "source", "id").select("id", F.col("prediction").alias("by_source"))
    return rounded(a.join(b, "id"), 5)


#: The nested scheme: an outer fold's strength is the best over four inner folds of the other groups, by pooled predictions.
_NESTED = f"""{_ROWS}, ig as (select held, grp, ntile(4) over (partition by held order by sha256('3|' || held || '|' || grp), grp) as ifold from fg, range(1, 6) h(held) where held <> fg.fold),
    tr as (select rows.*, held, ifold from rows join ig using (grp)), al as (select unnest([1.0, 100.0, 10000.0]) as al),
    t as (select held, ifold, al, n, sy, sa, sb, saa, sab, sbb, say, sby from (select distinct held, ifold from tr) g, al, lateral (select {_SUMS} from tr x where x.held = g.held and x.ifold <> g.ifold) sums), {_SOLVE},
    pr as (select tr.held, f.al, y, my - ca * ma - cb * mb + ca * tr.a + cb * tr.b as p from tr join f on f.held = tr.held and f.ifold = tr.ifold),
    rk as (select held, al, rank() over (partition by held, al order by p) + (count(*) over (partition by held, al, p) - 1) / 2.0 as rp, rank() over (partition by held, al order by y) + (count(*) over (partition by held, al, y) - 1) / 2.0 as ry from pr),
    scored as (select held, al, round(covar_pop(rp, ry) / (stddev_pop(rp) * stddev_pop(ry)), 9) as score from rk group by all)"""


@query(f"""with {_NESTED} select cast(held as integer) as held, al as alpha, round(score, 4) as score from scored""")
def k9_inner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_rows(spark, sf_dir)
    placed = once(grouped_folds(rows, "grp", 5, 3).withColumnRenamed("fold", "outer"), "placed")
    training = once(nested.inner_folds(placed, "grp", 5, 4, 3), "training")
    return rounded(nested.inner_scores(training, "y", FEATURES, [1.0, 100.0, 10000.0]), 4)


#: Ridge on the first feature alone.
_SOLVE_FIRST = "f as (select *, sa / n as ma, 0.0 as mb, sy / n as my, (say - sa * sy / n) / ((saa - sa * sa / n) / n) / (n + al) as ca, 0.0 as cb from t)"


def _nested_sql(seed: int = 3, alphas: str = "[1.0, 100.0, 10000.0]", features: str = "ab") -> str:
    """(id, y, prediction) of nested selection: the best strength of an outer fold, then the fit on all other outer folds."""
    solve = _SOLVE if features == "ab" else _SOLVE_FIRST
    text = f"""{_NESTED}, best as (select held, first(al order by -coalesce(score, -2), abs(log10(al)), al) as al from scored group by held),
        fo as (with t as (select b.held, b.al, sums.* from best b, lateral (select {_SUMS} from fr x where x.fold <> b.held) sums), {_SOLVE} select * from f)
        select id, y, my - ca * ma - cb * mb + ca * fr.a + cb * fr.b as prediction from fr join fo on fo.held = fr.fold"""
    text = text.replace(_SOLVE, solve).replace("[1.0, 100.0, 10000.0]", alphas).replace("'3|'", f"'{seed}|'")
    return "with " + (text if features != "b" else text.replace("coalesce(a, 0) as a, coalesce(b, 0) as b", "coalesce(b, 0) as a, coalesce(a, 0) as b"))


@query(f"""select id, round(avg(prediction), 5) as prediction, count(*) as repeats from (({_nested_sql(3)}) union all ({_nested_sql(4)})) group by id""")
def k10_nested_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order predicted by nested selection under two seeds."""
    return rounded(nested.repeated_predictions(price_rows(spark, sf_dir), "id", "grp", "y", FEATURES, [1.0, 100.0, 10000.0], [3, 4]), 5)


_SPECS = " union all ".join(f"select '{name}' as spec, * from ({_nested_sql(3, '[1.0, 100.0]', f)})" for name, f in (("both", "ab"), ("lines", "a"), ("quantity", "b")))


@query(f"""with p as ({_SPECS}), r as (select spec, rank() over (partition by spec order by prediction) + (count(*) over (partition by spec, prediction) - 1) / 2.0 as x, rank() over (partition by spec order by y) + (count(*) over (partition by spec, y) - 1) / 2.0 as z from p)
    select spec, round(round(covar_pop(x, z) / (stddev_pop(x) * stddev_pop(z)), 9), 4) as score, count(*) as n from r group by spec""")
def k13_compared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nested.compare_specs(price_rows(spark, sf_dir), "grp", "y", {"both": ["a", "b"], "lines": ["a"], "quantity": ["b"]}, [1.0, 100.0], seed=3), 4)


_ONE = lambda x: f"my_{x} + c_{x} * ({x} - m_{x})"
#: Ridge of strength 1 on one feature from sums, by Cramer's rule of one.
_FIT_ONE = lambda x: f"sy / n as my_{x}, s{x} / n as m_{x}, (s{x}y - s{x} * sy / n) / sqrt((s{x}{x} - s{x} * s{x} / n) / n) / ((s{x}{x} - s{x} * s{x} / n) / ((s{x}{x} - s{x} * s{x} / n) / n) + 1) / sqrt((s{x}{x} - s{x} * s{x} / n) / n) as c_{x}"


@query(f"""with recursive {_ROWS}, ig as (select held, grp, ntile(4) over (partition by held order by sha256('3|' || held || '|' || grp), grp) as ifold from fg, range(1, 6) h(held) where held <> fg.fold),
    tr as (select rows.*, held, ifold from rows join ig using (grp)),
    fi as (select g.held, g.ifold, {_FIT_ONE('a')}, {_FIT_ONE('b')} from (select distinct held, ifold from tr) g, lateral (select {_SUMS} from tr x where x.held = g.held and x.ifold <> g.ifold) sums),
    oof as (select held, y, {_ONE('a')} as p, {_ONE('b')} as q from tr join fi using (held, ifold)),
    ms as (select held, count(*)::double as n, sum(y) as sy, sum(p) as sp, sum(q) as sq, sum(p * p) - sum(p) * sum(p) / count(*) as cpp, sum(p * q) - sum(p) * sum(q) / count(*) as cpq, sum(q * q) - sum(q) * sum(q) / count(*) as cqq, sum(p * y) - sum(p) * sum(y) / count(*) as cpy, sum(q * y) - sum(q) * sum(y) / count(*) as cqy from oof group by held),
    mz as (select *, sqrt(cpp / n) as dp, sqrt(cqq / n) as dq, cpp / (cpp / n) + 1 as zpp, cqq / (cqq / n) + 1 as zqq, cpq / (sqrt(cpp / n) * sqrt(cqq / n)) as zpq, cpy / sqrt(cpp / n) as zp, cqy / sqrt(cqq / n) as zq from ms),
    it as (select held, 0 as k, 0.0::double as u, 0.0::double as v from mz union all select it.held, k + 1, greatest(0.0, u - (zpp * u + zpq * v - zp) / (zpp + zqq)), greatest(0.0, v - (zpq * u + zqq * v - zq) / (zpp + zqq)) from it join mz on mz.held = it.held where k < 500),
    wt as (select held, u / dp as wp, v / dq as wq, sy / n - u / dp * sp / n - v / dq * sq / n as w0 from it join mz using (held) where k = 500),
    fo as (select g.fold, {_FIT_ONE('a')}, {_FIT_ONE('b')} from (select distinct fold from fr) g, lateral (select {_SUMS} from fr x where x.fold <> g.fold) sums)
    select id, fr.fold as outer, round({_ONE('a')}, 5) as lines, round({_ONE('b')}, 5) as quantity, round(w0 + wp * ({_ONE('a')}) + wq * ({_ONE('b')}), 5) as prediction from fr join fo on fo.fold = fr.fold join wt on wt.held = fr.fold""")
def k7_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nested.stacked_predictions(price_rows(spark, sf_dir), "grp", "y", {"lines": ["a"], "quantity": ["b"]}, seed=3)
    return rounded(out.select("id", "outer", "lines", "quantity", "prediction"), 5)


@query("""with m as (select o_orderkey as id, 'price' as model, cast(o_totalprice as double) as s from orders union all select o_orderkey, 'date', cast(epoch(o_orderdate) as double) from orders),
    r as (select id, count(*) over (partition by model order by s range unbounded preceding) / count(*) over (partition by model) as p from m) select id, round(avg(p), 6) as prediction from r group by id""")
def k7_rank_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderkey").alias("id"), F.lit("price").alias("model"), F.col("o_totalprice").cast("double").alias("s")).union(o.select("o_orderkey", F.lit("date"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")))
    return rounded(nested.rank_ensemble(m, "id", "model", "s"))


@query("""with p as (select o_orderkey as id, o_orderkey % 2 as repeat, o_orderkey % 3 as fold, m as model, cast(o_totalprice as double) * length(m) as prediction from orders, (select unnest(['ab', 'c', 'def']) as m)),
    l as (select repeat, fold, model, round(avg(prediction / length(model)), 2) as score from p group by all), b as (select repeat, fold, first(model order by score desc, model) as model from l group by all)
    select id, repeat, model, round(prediction, 4) as prediction from p join b using (repeat, fold, model)""")
def k11_selected_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("model", F.explode(F.array(F.lit("ab"), F.lit("c"), F.lit("def"))))
    p = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).alias("repeat"), (F.col("o_orderkey") % 3).alias("fold"), "model", (F.col("o_totalprice").cast("double") * F.char_length("model")).alias("prediction"))
    log = p.groupBy("repeat", "fold", "model").agg(F.round(F.avg(F.col("prediction") / F.char_length("model")), 2).alias("score"))
    return rounded(nested.select_models(log, p, "id"), 4)


@query(f"""with {_ROWS}, t as (select 10.0 as al, {_SUMS} from rows), {_SOLVE}, p as (select id, round(my - ca * ma - cb * mb + ca * rows.a + cb * rows.b, 7) as p from rows, f),
    q as (select id, p, (count(*) over (order by p range unbounded preceding) + 0.5) / (count(*) over () + 1) as e from p)
    select id, round(round(100 * e, 6), 4) as percentile, cast(row_number() over (order by round(100 * e, 6) desc, id) as integer) as batch_rank, 'accepted' as status from q""")
def k12_final_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = price_rows(spark, sf_dir)
    fit, reference = nested.final_fit(rows, "y", FEATURES, 10.0)
    reference = reference.withColumn("prediction", F.round("prediction", 7))
    scored = nested.predict(rows, fit, [], FEATURES).drop("alpha").withColumn("prediction", F.round("prediction", 7))
    placed = nested.ecdf_percentile(scored, reference, "prediction", smoothed=True).withColumn("percentile", F.round(100 * F.col("percentile"), 6))
    return rounded(nested.batch_rank(placed, "percentile", "id").select("id", "percentile", "batch_rank", F.lit("accepted").alias("status")), 4)


@query(f"""with {_ROWS}, t as (select 10.0 as al, {_SUMS} from rows), {_SOLVE}, p as (select id, round(my - ca * ma - cb * mb + ca * rows.a + cb * rows.b, 7) as p from rows, f),
    q as (select id, p, (count(*) over (order by p range unbounded preceding) + 0.5) / (count(*) over () + 1) as e from p)
    select id, round(p, 5) as prediction, round(round(100 * e, 6), 4) as percentile, cast(row_number() over (order by round(100 * e, 6) desc, id) as integer) as batch_rank, 'validated' as status from q""")
def k12_stored_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit that is written as a bundle, loaded from it and put to the rows."""
    rows = price_rows(spark, sf_dir)
    path = f"{shared_folder(spark).rstrip('/')}/fit-{uuid.uuid4().hex}"
    artifact.save_artifact(rows, "y", FEATURES, 10.0, path, accepted=True, forbidden=["views", "percentile"], decimals=7)
    scored = artifact.score_with(rows.select("id", *FEATURES), artifact.load_artifact(spark, path), "id")
    return scored.select("id", F.round("prediction", 5).alias("prediction"), F.round("percentile", 4).alias("percentile"), "batch_rank", "status")


@query("""select s_suppkey, cast(row_number() over (order by round(cast(s_acctbal as double) / 1000, 0) desc, s_suppkey) as integer) as batch_rank from supplier""")
def i6_batch_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").withColumn("score", F.round(F.col("s_acctbal").cast("double") / 1000, 0))
    return nested.batch_rank(s, "score", "s_suppkey").select("s_suppkey", "batch_rank")


@query("""with x as (select c_custkey as id, cast(c_acctbal as double) as a, cast(c_nationkey as double) as b, c_custkey % 10 as c from customer), s as (select *, round(a * 0.5 + b * 0.25 + c * 0.25, 9) as score from x)
    select id, round(score, 5) as score, round(least(a, b, c), 5) as least, round(greatest(a, b, c), 5) as greatest, round(list_stddev_pop([a, b, c]), 5) as spread, round((select count(*) from s r where r.score <= s.score) / (select count(*) from s), 6) as percentile from s""")
def i11_ensemble_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").cast("double").alias("b"), (F.col("c_custkey") % 10).cast("double").alias("c"))
    members = {"a": 0.5, "b": 0.25, "c": 0.25}
    reference = x.select(F.round(0.5 * F.col("a") + 0.25 * F.col("b") + 0.25 * F.col("c"), 9).alias("score"))
    out = nested.ensemble_scores(x, members, reference, "id").select("id", "score", "least", "greatest", "spread", "percentile")
    return rounded(out.withColumn("percentile", F.round("percentile", 6)), 5).drop("percentile").join(out.select("id", F.round("percentile", 6).alias("percentile")), "id")


_STRATA = """x as (select l.doc_id as id, source as ch, toxic as y, length(regexp_replace(text, '[^aeiou]', '', 'g')) / greatest(1, n_chars) as s from labels l join documents d on d.doc_id = l.doc_id where text is not null and n_chars is not null),
    k as (select *, row_number() over (partition by ch, y order by id) - 1 as i, count(*) over (partition by ch, y) as n, count(*) filter (y = 1) over (partition by ch) as pos, count(*) filter (y = 0) over (partition by ch) as neg from x where y in (0, 1)),
    t as (select * from k where pos >= 3 and neg >= 3),
    dr as (select r, t.ch, t.y, u.s from t, range(2000) q(r) join t u on u.ch = t.ch and u.y = t.y and u.i = ('0x' || substr(md5('7|' || r || '|' || t.ch || '|' || t.y || '|' || t.i), 1, 8))::bigint % t.n)"""
_AUC = lambda src, by: f"(select {by} ch, sum((rk - (p + 1) / 2.0)) filter (y = 1) / any_value(p * q) as auc from (select {by} ch, y, rank() over (partition by {by} ch order by s) + (count(*) over (partition by {by} ch, s) - 1) / 2.0 as rk, count(*) filter (y = 1) over (partition by {by} ch) as p, count(*) filter (y = 0) over (partition by {by} ch) as q from {src}) group by {by} ch)"


@query(f"""with {_STRATA}, m as (select r, avg(auc) as m from {_AUC('dr', 'r,')} group by r)
    select (select round(avg(auc), 5) from {_AUC('t', '')}) as macro_auc, (select count(distinct ch) from t) as channels, round(quantile_cont(m, 0.025), 5) as low, round(quantile_cont(m, 0.5), 5) as median, round(quantile_cont(m, 0.975), 5) as high, count(m) as valid from m""")
def l3_stratified_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").where("text is not null and n_chars is not null").select("doc_id", "source", (F.char_length(F.regexp_replace("text", "[^aeiou]", "")) / F.greatest(F.lit(1), F.col("n_chars"))).alias("s"))
    rows = load(spark, sf_dir, "labels").join(d, "doc_id")
    return rounded(nested.stratified_bootstrap(rows, "source", "toxic", "s", "doc_id", 2000, 7), 5)
