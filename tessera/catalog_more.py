"""Queries of the pool, its policies and studies, further decisions and profiles, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _BOTH, _INDEX, _MACRO, _PERQ, _RECS, _S, _SEL, _SIG, _lists, _nq, _nrec, _pairs_df, _pool, _qs, _REL, _sel, _stored, query
from .functions import strsim
from .operators import artifacts, blocking, candidates, compete, decide, features, metrics, model
from .plans import fixtures as FX
from .sources import io

# ---- the pool from records to annotations ------------------------------------------------------------------------

_POOLED = f"""{_INDEX}, {_SIG}, small as (select * from (select *, count(*) over (partition by country, sig) as n from sig) where n <= 12),
hit as (select distinct s1, country, sig from pool join small using (r) where prk <= 10),
ex2 as (select e.s1, e.r from (select distinct s1, small.r from hit join small using (country, sig)) e anti join pool on e.s1 = pool.s1 and e.r = pool.r),
un as (select s1, r, sc::double as sc, prk, xrk, a4, false as exp from pool where prk <= 60 or xrk is not null union all select s1, r, 0, null, null, false, true from ex2),
gr as (select un.*, case when sig.sig is null then 'r:' || un.r else sig.country || '/' || sig.sig end as gid from un left join sig on un.r = sig.r),
cd as (select s1, r, case when exp then .999e0 * max(sc) over (partition by s1, gid) else sc end as sc, prk, xrk, a4, exp, gid from gr),
an as (select cd.*, q.ad as ad_s, n.ad as ad_r, list_distinct(q.ad) as x, list_distinct(n.ad) as y from cd join q on cd.s1 = q.entity_id join n on cd.r = n.entity_id),
rl as (select *, {_REL} as rel, max(sc) over (partition by r) as m from an)"""


def _candidates(spark, sf):
    return candidates.candidates(*_stored(spark, sf))


_ROW = "s1, r, round(sc, 3) as sc, prk, xrk, exp, gid, rel"


@query("candidates", f"{_POOLED} select {_ROW}, round(coalesce((sc - m) / nullif(m, 0), 0), 6) as rev_margin from rl")
def _(spark, sf):
    d = _candidates(spark, sf)
    return d.select("s1", "r", F.round("sc", 3).alias("sc"), F.col("prk").cast("long").alias("prk"), F.col("xrk").cast("long").alias("xrk"), "exp", "gid", "rel", F.round("rev_margin", 6).alias("rev_margin"))


_GATED = """, gp as (select s1, gid, max(sc) as gs, bool_and(rel = 'disjoint') and not bool_or(a4) as odd from rl group by s1, gid),
gk as (select *, row_number() over (partition by s1 order by gs desc, gid) as grk, max(gs) over (partition by s1) as top from gp),
pr as (select rl.s1, rl.r, row_number() over (partition by rl.s1 order by sc desc, rl.r) as k from rl join gk on rl.s1 = gk.s1 and rl.gid = gk.gid
       where gs >= .4e0 * top and grk <= 20 and not odd and coalesce((sc - m) / nullif(m, 0), 0) >= -.5e0)"""


@query("policy", f"{_POOLED}{_GATED} select s1, r from pr where k <= 25")
def _(spark, sf):
    return candidates.apply_policy(_candidates(spark, sf), {"alpha": 0.4, "groups": 20, "gate": True, "beta": 0.5, "kmax": 25}).select("s1", "r")


@query("fused_ranks", f"{_INDEX}, f as (select s1, r, round(sum(1e0 / (20 + rk)), 9) as rrf from kept group by s1, r), k as (select *, row_number() over (partition by s1 order by rrf desc, r) as rk from f) select * from k where rk <= 60")
def _(spark, sf):
    return candidates.fused(blocking.unpacked(_lists(spark, sf))).withColumn("rk", F.col("rk").cast("long"))


@query("arm_diagnosis", f"""{_INDEX}, gt as ({FX.TRUTH}), a as (select qx.id as s1, ix.id as r, arm, sum(idf)::bigint as sc, count(*) as shared, min(df) as dfs from qx join wt using (country, arm, t) join ix using (country, arm, t) group by all),
    b as (select *, row_number() over (partition by s1, arm order by sc desc, r) as rk from a) select b.s1, b.r, arm, shared, dfs, rk from b join gt on b.s1 = gt.s1 and b.r = gt.r""")
def _(spark, sf):
    return candidates.arm_diagnosis(FX.truth(spark, sf), _nq(spark, sf), _nrec(spark, sf)).withColumn("rk", F.col("rk").cast("long"))


@query("sampled_reverse")
def _(spark, sf):
    q = _nq(spark, sf)
    half = model.sampled(q, "entity_id", 40)
    return candidates.candidates(half, _nrec(spark, sf), others=q).select("s1", "r", F.round("rev_margin", 6).alias("rev_margin"))


@query("single_score")
def _(spark, sf):
    return candidates.single_score(_nq(spark, sf), _nrec(spark, sf))


@query("frontier")
def _(spark, sf):
    grid = [{"name": f"a{a}-g{g}-{gate}", "alpha": a, "groups": g, "gate": gate} for a in (0.0, 0.3, 0.6) for g in (3, 99) for gate in (False, True)]
    d = _candidates(spark, sf)
    return candidates.frontier(d, FX.truth(spark, sf), _qs(spark, sf), grid)


# ---- decisions ---------------------------------------------------------------------------------------------------

# the number of true pairs among all but one is summed over subsets, so lists are kept short: the three best pairs of a query
_EF = """, k3 as (select s1, r, p, rk from rk where rk <= 3),
ls as (select s1, count(*) as m, max(p) filter (rk = 1) as p1, coalesce(max(p) filter (rk = 2), 0) as p2, coalesce(max(p) filter (rk = 3), 0) as p3 from k3 group by s1),
wd as (select ls.*, y1, y2, y3, (case y1 when 1 then p1 else 1 - p1 end) * (case y2 when 1 then p2 else 1 - p2 end) * (case y3 when 1 then p3 else 1 - p3 end) as w
       from ls, (select unnest([0, 1]) as y1) a, (select unnest([0, 1]) as y2) b, (select unnest([0, 1]) as y3) c),
ek as (select s1, k, sum(w * case when k = 0 then (y1 + y2 + y3 = 0)::int::double
         else 1.25e0 * (y1 + case when k > 1 then y2 else 0 end + case when k > 2 then y3 else 0 end) / (.25e0 * (y1 + y2 + y3) + k) end) as e
       from wd, (select unnest([0, 1, 2, 3]) as k) kk group by s1, k),
bk as (select s1, max_by(k, e) as k from (select s1, k, round(e, 12) - k * 1e-13 as e from ek) group by s1)"""


@query("expected_f_three", f"{_S}, rk as (select *, row_number() over (partition by s1 order by p desc, r) as rk from d){_EF} select k3.s1, r, p from k3 join bk using (s1) where rk <= k")
def _(spark, sf):
    three = decide.ranked(FX.scored(spark, sf)).filter("rk <= 3").drop("rk")
    return decide.expected_f_decode(three, width=3).select("s1", "r", "p")


@query("decide_head")
def _(spark, sf):
    d = FX.scored(spark, sf)
    has = d.groupBy("s1").agg(F.round(1 - F.exp(F.sum(F.log1p(-F.col("p") * 0.9))), 6).alias("h"))
    return decide.decide(d, {"rule": "head", "gamma": 0.9}, has).select("s1", "r")


@query("tune_by_country", f"""{_S}, qc as (select entity_id as s1, country from ({FX.S1})), rk as (select s1, r, p, row_number() over (partition by s1 order by p desc, r) as rk from d),
    pts as (select a / 10e0 as t1, b / 10e0 as t2 from (select unnest([6, 7, 8, 9]) as a) x, (select unnest([6, 7, 8, 9]) as b) y),
    got as (select t1, t2, rk.s1, count(*) as np, count(gt.s1) as tp from rk join pts on p > case when rk = 1 then t1 else t2 end left join gt on gt.s1 = rk.s1 and gt.r = rk.r group by all),
    nt as (select qc.s1, country, count(gt.s1) as nt from qc left join gt using (s1) group by all),
    ea as (select country, t1, t2, round(avg(case when coalesce(np, 0) = 0 and nt = 0 then 1e0 when coalesce(tp, 0) = 0 then 0e0 else 1.25e0 * tp / (.25e0 * nt + np) end), 6) as f
           from nt cross join pts left join got using (s1, t1, t2) group by all)
    select country, t1, t2, f from (select *, row_number() over (partition by country order by f desc, t1, t2) as k from ea) where k = 1""")
def _(spark, sf):
    queries = FX.s1(spark, sf).select(F.col("entity_id").alias("s1"), "country")
    return decide.tune_by(FX.scored(spark, sf), FX.truth(spark, sf), queries, "country", [(a / 10, b / 10) for a in range(6, 10) for b in range(6, 10)])


@query("tune_gamma")
def _(spark, sf):
    return decide.tune_gamma(FX.scored(spark, sf), FX.truth(spark, sf), _qs(spark, sf))


@query("redecided", f"{_S}{_SEL}, un as (select distinct s1 from d where p > .3 and p < .32), nw as (select s1, r from d where p > .6) select s1, r from sel where s1 not in (select s1 from un) union all select s1, r from nw where s1 in (select s1 from un)")
def _(spark, sf):
    d = FX.scored(spark, sf)
    return decide.redecided(_sel(spark, sf), d, d.filter("p > 0.6"), 0.3, 0.32)


@query("conditioned_top1", f"{_S}, m as (select *, coalesce((sc - max(sc) over (partition by r)) / nullif(max(sc) over (partition by r), 0)::double, 0) as rev from d), k as (select *, row_number() over (partition by s1 order by p desc, r) as rk from m) select s1, r from k where p > case when rk = 1 then case when rev > -.2e0 then .6 else .9 end else .85 end")
def _(spark, sf):
    return decide.conditioned_top1(blocking.reverse_margin(FX.scored(spark, sf)), 0.9, 0.6, 0.2, 0.85).select("s1", "r")


# ---- studies -----------------------------------------------------------------------------------------------------


@query("recall_slices", f"""{_INDEX}, gt as ({FX.TRUTH}), raw as ({FX.RECORDS}),
    h as (select gt.s1, gt.r, case when pool.r is null then 0e0 else 1e0 end as hit, q.country, n.noaddr, regexp_matches(raw.business_name, '[é]') as indic
          from gt left join pool on gt.s1 = pool.s1 and gt.r = pool.r join q on gt.s1 = q.entity_id join n on gt.r = n.entity_id join raw on gt.r = raw.entity_id),
    e as (select 'all' as slice, hit from h union all select 'country:' || country, hit from h union all select 'noaddr', hit from h where noaddr union all select 'indic', hit from h where indic)
    select slice, count(*) as n, round(avg(hit), 6) as recall from e group by slice""")
def _(spark, sf):
    marks = FX.records(spark, sf).select("entity_id", F.col("business_name").rlike("é").alias("indic"))  # the fixtures' names with marks stand for another script
    return metrics.recall_slices(_pool(spark, sf), FX.truth(spark, sf), FX.s1(spark, sf), _nrec(spark, sf).select("entity_id", "noaddr").join(marks, "entity_id"))


@query("orphan_f", f"""{_S}{_SEL}, w as (select sel.s1, count(g.s1) as tp, sum(case when o.r is null then 2e0 else 1e0 end) as np from sel left join gt g on g.s1 = sel.s1 and g.r = sel.r left join (select distinct r from gt) o on o.r = sel.r group by sel.s1),
    t as (select s1, count(*) as nt from gt group by s1), f as (select coalesce(nt, 0) as nt, coalesce(tp, 0) as tp, coalesce(np, 0) as np from qs left join w using (s1) left join t using (s1))
    select round(avg(round(case when np = 0 and nt = 0 then 1e0 when tp = 0 then 0e0 else 1.25e0 * tp / (.25e0 * nt + np) end, 9)), 6) as f05 from f""")
def _(spark, sf):
    return metrics.orphan_f(_sel(spark, sf), FX.truth(spark, sf), _qs(spark, sf))


_PSEUDO = "ps as (select s1, r from d where sc % 3 = 0)"


@query("transfer_rate", f"{_S}{_SEL}, {_PSEUDO}, e as (select ps.s1, ps.r, coalesce(max((sel.s1 = ps.s1)::int), 0) as own, count(sel.s1) as n from ps left join sel on sel.r = ps.r group by all) select count(*) as n, round(avg(own::double), 6) as hit, round(avg((own = 0 and n > 0)::int::double), 6) as other from e")
def _(spark, sf):
    return metrics.transfer_rate(_sel(spark, sf), FX.scored(spark, sf).filter("sc % 3 = 0").select("s1", "r"))


@query("profile", f"""with f as (select country, unnest(['business_name', 'business_address']) as field, unnest([business_name, business_address]) as x from ({FX.RECORDS}))
    select country, field, count(*) as n, count(distinct x) as n_unique, round(avg((x is null or trim(x) = '')::int::double), 6) as missing, round(median(length(x)), 6) as median_length,
    round(avg(coalesce(regexp_matches(x, '\\d'), false)::int::double), 6) as digits, round(avg(coalesce(regexp_matches(x, '^[A-Z ]+$'), false)::int::double), 6) as capitals from f group by all""")
def _(spark, sf):
    return metrics.profile(FX.records(spark, sf), {"digits": r"\d", "capitals": "^[A-Z ]+$"})


@query("contingency", f"""{_BOTH}, p as (select q.country, q.ad as ad_s, n.ad as ad_r, list_distinct(q.ad) as x, list_distinct(n.ad) as y from q join n on q.k // 8 = cast(substr(n.entity_id, 4) as bigint) // 10 // 8), r as (select country, {_REL} as rel from p)
    select country, count(*) filter (rel = 'equal') as equal, count(*) filter (rel = 'trunc') as trunc, count(*) filter (rel = 'disjoint') as disjoint, count(*) filter (rel = 'missing') as missing from r group by country""")
def _(spark, sf):
    d = _pairs_df(spark, sf).join(_nq(spark, sf).select(F.col("entity_id").alias("s1"), F.col("country").alias("c")), "s1")
    d = d.select(F.col("c").alias("country"), blocking.number_relation(F.col("ad_s"), F.col("ad_r")).alias("rel"))
    return metrics.contingency(d, "country", "rel", ["equal", "trunc", "disjoint", "missing"])


@query("id_gaps", f"""with d as (select country, cast(substr(entity_id, 4) as bigint) as num from ({FX.RECORDS})), g as (select country, num, num - lag(num) over w as gap, row_number() over w as pos from d window w as (partition by country order by num))
    select country, count(*) as n, count(*) filter (gap = 1) as gap_1, max(gap) as longest, round(corr(num, pos), 6) as corr from g group by country""")
def _(spark, sf):
    return metrics.id_gaps(FX.records(spark, sf).select("country", F.substring("entity_id", 4, 20).cast("long").alias("num")), "country", "num")


@query("ownership", f"""with gt as ({FX.TRUTH}), r as (select entity_id as r, count(gt.s1) as n from ({FX.RECORDS}) x left join gt on gt.r = x.entity_id group by 1), q as (select entity_id as s1, count(gt.r) as n from ({FX.S1}) x left join gt on gt.s1 = x.entity_id group by 1)
    select (select round(avg((n = 0)::int::double), 6) from r) as orphans, (select round(avg((n = 0)::int::double), 6) from q) as singles, (select count(*) from r where n > 1) as shared""")
def _(spark, sf):
    return metrics.ownership(FX.truth(spark, sf), FX.records(spark, sf), _qs(spark, sf))


def _macro_of(rows: str) -> str:
    return f"(with sel as ({rows}){_PERQ} select round(avg(f), 6) from pf)"


@query("oracle_gains", f"""{_S}{_SEL}, ri as (select sel.s1, sel.r from sel join gt on sel.s1 = gt.s1 and sel.r = gt.r), fo as (select d.s1, d.r from d join gt on d.s1 = gt.s1 and d.r = gt.r)
    select {_macro_of("select s1, r from sel")} as f05, {_macro_of("select * from ri")} as no_wrong, {_macro_of("select s1, r from sel union select * from fo")} as all_found, {_macro_of("select * from ri union select * from fo")} as both""")
def _(spark, sf):
    return metrics.oracle_gains(_sel(spark, sf), FX.scored(spark, sf), FX.truth(spark, sf), _qs(spark, sf))


@query("group_features", f"{_S}, w as (select *, case when sc % 4 = 0 then null else gid end as g, sc % 3 as house_rel, sc / 50e0 as nm_tset from d) select s1, r, count(*) over v as grp_size, sum((house_rel = 0)::int) over v::bigint as grp_house_eq, round(avg(nm_tset) over v, 6) as grp_nm_tset_mean from w window v as (partition by s1, coalesce(g, 'r:' || r))")
def _(spark, sf):
    d = FX.scored(spark, sf).withColumn("gid", F.when(F.col("sc") % 4 == 0, F.lit(None)).otherwise(F.col("gid"))).withColumn("house_rel", F.col("sc") % 3).withColumn("nm_tset", F.col("sc") / 50.0)
    return features.group_features(d).select("s1", "r", "grp_size", "grp_house_eq", "grp_nm_tset_mean")


# ---- learnt tables -----------------------------------------------------------------------------------------------


@query("country_synonyms")
def _(spark, sf):
    p = _nq(spark, sf).select("k", "country", F.col("aw").alias("a")).join(_nrec(spark, sf).select("k", F.col("aw").alias("b")), "k")
    return artifacts.country_synonyms(p, min_n=2)


@query("hidden_words")
def _(spark, sf):
    p = _nq(spark, sf).select("k", F.col("core").alias("a")).join(_nrec(spark, sf).select("k", F.col("core").alias("b")), "k")
    lexicon = artifacts.indic_lexicon(p)
    return artifacts.hidden_words(lexicon, lambda shown, hidden: artifacts.oov_map(hidden, shown.select(F.lit("-").alias("country"), F.col("latin").alias("token"), "n")))


@query("street_twins")
def _(spark, sf):
    return model.street_twins(FX.truth(spark, sf), FX.records(spark, sf).select("entity_id", "business_name", "business_address", "country"))


@query("head_inputs", f"""{_S}, k as (select *, row_number() over (partition by s1 order by p desc, r) as rk from d)
    select s1, max(p) as p1, coalesce(max(p) filter (rk = 2), 0) as p2, round(sum(p), 4) as psum, count(*) filter (p > .5) as n05, count(*) as nc, count(*) filter (sc % 6 = 0) as n_house_eq, max(sc) / 5e1 as nm_max from k group by s1""")
def _(spark, sf):
    d = FX.scored(spark, sf).withColumn("house_rel", (F.col("sc") % 6).cast("int")).withColumn("nm_tset", F.col("sc") / 50.0)
    return model.head_inputs(d).select("s1", "p1", "p2", F.round("psum", 4).alias("psum"), "n05", "nc", "n_house_eq", "nm_max")


# ---- written lists and their rules -------------------------------------------------------------------------------

_BROKEN = """br as (select s1, r from sel union all select s1, r from sel where s1 like '%1' union all select s1, 'S9-' || s1 from qs where s1 like '%2' union all select s1, s1 from qs where s1 like '%3' union all select 'S1-none', 'S2-none')"""


@query("violations_of_a_broken_list", f"""{_S}{_SEL}, {_BROKEN}, rec as (select entity_id as r from ({FX.RECORDS})), cq as (select s1 from qs union all select s1 from qs where s1 like '%4')
    select 'duplicate_query' as rule, (select count(*) from (select s1 from cq group by s1 having count(*) > 1)) as n
    union all select 'duplicate_match', (select count(*) from (select s1, r from br group by s1, r having count(*) > 1))
    union all select 'wrong_prefix', (select count(*) from br where not regexp_matches(r, '^S[23]-'))
    union all select 'self_match', (select count(*) from br where s1 = r)
    union all select 'unknown_record', (select count(*) from br where r not in (select r from rec))
    union all select 'unknown_query', (select count(*) from br where s1 not in (select s1 from cq))
    union all select 'not_a_candidate', (select count(*) from br where not exists (select 1 from d where d.s1 = br.s1 and d.r = br.r and d.p < .9))""")
def _(spark, sf):
    sel, qs = _sel(spark, sf).select("s1", "r"), _qs(spark, sf)
    br = sel.unionByName(sel.filter("s1 like '%1'")).unionByName(qs.filter("s1 like '%2'").select("s1", F.concat(F.lit("S9-"), "s1").alias("r")))
    br = br.unionByName(qs.filter("s1 like '%3'").select("s1", F.col("s1").alias("r"))).unionByName(spark.range(1).select(F.lit("S1-none").alias("s1"), F.lit("S2-none").alias("r")))
    twice = qs.unionByName(qs.filter("s1 like '%4'"))
    return io.violations(br, FX.scored(spark, sf).filter("p < 0.9"), twice, FX.records(spark, sf)).select("rule", "n")


# ---- likeness of texts -------------------------------------------------------------------------------------------


@query("name_scores")
def _(spark, sf):
    return features.string_features(_pairs_df(spark, sf)).select("s1", "r", *(F.round(c, 6).alias(c) for c in (*strsim.NAMES, "co_tset", "co_alias_tset", "ad_tset", "bag_ratio", "st_sim")))


@query("all_set_features")
def _(spark, sf):
    cols = "n_num_s n_num_r n_missing_r n_extra_sk n_missing_sk n_decoy_extra unit_rel num_rel".split()
    return features.set_features(_pairs_df(spark, sf)).select("s1", "r", *cols)


@query("sibling_scores")
def _(spark, sf):
    t = _nrec(spark, sf).select(F.col("entity_id").alias("r"), F.array_join("aw", " ").alias("addr"), F.array_join("nw", " ").alias("name"))
    return compete.siblings(FX.scored(spark, sf).select("s1", "r", "p"), t, 0.9)
