"""All queries of the library, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import tables as T
from .functions import text as X
from .operators import artifacts, blocking, compete, decide, features, metrics, model, normalize
from .plans import fixtures as FX
from .sources import io
from .sources.shared import cut

_FOUND: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        _FOUND[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict:
    return dict(_FOUND)


def oracle_sql() -> dict:
    return dict(_SQL)


# ---- SQL of the normaliser ---------------------------------------------------------------------------------------


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _fold(x: str) -> str:
    return f"lower(strip_accents(coalesce({x}, '')))"


def _clean(x: str) -> str:
    x = _fold(x)
    for _ in range(3):
        x = rf"regexp_replace({x}, '([a-z])\.([a-z])', '\1\2', 'g')"
    return rf"regexp_replace(regexp_replace(replace({x}, '.', ' '), '[&+]', ' and ', 'g'), '^\s*none\s*$', '')"


def _digits(x: str) -> str:
    for w, d in T.NUMBER_WORDS.items():
        x = rf"regexp_replace({x}, '\b{w}\b', '{d}', 'g')"
    return rf"regexp_replace({x}, '\b(\d+)(st|nd|rd|th)\b', '\1', 'g')"


def _leet(x: str) -> str:
    return f"case when regexp_matches({x}, '^[a-z]*[0-9][a-z]*$') and length({x}) >= 4 then translate({x}, '{''.join(T.LEET)}', '{''.join(T.LEET.values())}') else {x} end"


def _skel(x: str) -> str:
    for a, b in (("c([eiy])", r"s\1"), ("z", "s"), ("ksh", "x"), ("ph", "f"), ("([bcdgjkpstz])h", r"\1"), ("ck", "k"), ("q", "k"), ("c", "k"), ("w", "v"), (r"\B[aeiouy]", "")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    for c in "bdfgjklmnprstvx":
        x = f"replace({x}, '{c}{c}', '{c}')"
    return x


def _once(a: str) -> str:
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


def _street(x: str) -> str:
    plain = " ".join(f"when '{k}' then '{v}'" for k, v in T.STREET.items())
    own = "".join(f"when country = '{c}' and {x} = '{k}' then '{v}' " for c, m in T.STREET_COUNTRY.items() for k, v in m.items())
    return f"case {own} else case {x} {plain} else {x} end end"


_PAT = r"(?i)^(.*?)\s(" + "|".join(m.replace("/", r"\s*/\s*") for m in T.ALIAS_MARKERS) + r")[:\s](.*)$"
# web handles of the fixtures are names without blanks, so the words of the name are what segmentation must find
_WEB = r"(?i)(^@|www\.|\.(com|in|net|org|co|fr|biz|info)\b)"
_IDS = r"#\s*\d+|\(id:?\s*\d+\)"
_GONE = _in([*T.LEGAL, *T.HONORIFIC, *T.NAME_STOP])


def _norm(src: str, name: str) -> str:
    """CTEs that end in ``name`` with the normalised records of ``src``."""
    return rf"""
{name}_w as (select x.entity_id, x.country, x.k, x.business_address, case when regexp_matches(x.business_name, '{_WEB}') then lower(o.business_name) else x.business_name end as business_name
   from ({src}) x left join ({FX.S1}) o on x.k = o.k),
{name}_0 as (select entity_id, country, k, business_address,
   case when regexp_matches(business_name, '{_PAT}') then regexp_extract(business_name, '{_PAT}', 3) else business_name end as main,
   case when regexp_matches(business_name, '{_PAT}') then regexp_extract(business_name, '{_PAT}', 1) else '' end as former from {name}_w),
{name}_1 as (select *, {_clean("main")} as cn, {_clean("former")} as cf, {_digits(_clean("business_address"))} as ca from {name}_0),
{name}_2 as (select *, list_transform(regexp_extract_all(regexp_replace(cn, '{_IDS}', ' ', 'g'), '[a-z0-9]+'), lambda x: {_leet("x")}) as nw0, regexp_extract_all(regexp_replace(cf, '{_IDS}', ' ', 'g'), '[a-z0-9]+') as al,
   list_filter(list_transform(regexp_extract_all(ca, '[a-z]+'), lambda x: {_street("x")}), lambda x: length(x) >= 2 and x not in {_in(T.ADDR_STOP)}) as aw0,
   list_filter(list_transform(regexp_extract_all(ca, '\d+'), lambda x: ltrim(x, '0')), lambda x: x <> '') as ad,
   list_transform(regexp_extract_all(ca, '\b[a-z]{{1,3}}[-/ ]?\d+[a-z]?\b'), lambda x: regexp_replace(regexp_replace(x, '[-/ ]', '', 'g'), '^([a-z]+)0+', '\1', 'g')) as au0 from {name}_1),
{name}_3 as (select *, {_once("nw0")} as nw, {_once("aw0")} as aw, {_once(f"list_filter(au0, lambda x: regexp_extract(x, '^[a-z]+') not in {_in(T.UNIT_EXCLUDE)})")} as au, trim(ca) = '' as noaddr from {name}_2),
{name}_4 as (select *, list_filter(nw, lambda x: x not in {_GONE}) as core, al as alias, list_filter(nw, lambda x: x in {_in(T.LEGAL)}) as legal from {name}_3),
{name}_5 as (select *, list_filter(list_transform(core, lambda x: {_skel("x")}), lambda x: length(x) >= 2) as sk0 from {name}_4),
{name} as (select *, {_once("sk0")} as sk from {name}_5)"""


_RECS = "with " + _norm(FX.RECORDS, "n")
_BOTH = _RECS + "," + _norm(FX.S1, "q")


@functools.lru_cache(8)
def _logp(spark, sf):
    """Word probabilities of the queries' names, for web handles; once for each folder."""
    return _words(_nq(spark, sf))


def _words(queries):
    return normalize.word_logp(artifacts.vocabulary(queries, min_n=1))


def _spread(spark, df):
    """The rows over all partitions of a shuffle: the source files are small, the work on a record is not."""
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "entity_id")


def _nrec(spark, sf):
    return normalize.normalise(_spread(spark, FX.records(spark, sf)), logp=_logp(spark, sf))


def _nq(spark, sf):
    return normalize.normalise(_spread(spark, FX.s1(spark, sf)))


def _stored(spark, sf):
    """Normalised queries and records for whoever reads them several times."""
    q = normalize.normalise_once(FX.s1(spark, sf))
    return q, normalize.normalise_once(FX.records(spark, sf), logp=_words(q))


def _j(c: str):
    return F.array_join(c, " ").alias(c)


def _dj(*cols: str) -> str:
    return ", ".join(f"array_to_string({c}, ' ') as {c}" for c in cols)


# ---- text --------------------------------------------------------------------------------------------------------


@query("text_base_clean", f"select entity_id, {_clean('business_name')} as name, {_clean('business_address')} as addr from ({FX.RECORDS})")
def _(spark, sf):
    return FX.records(spark, sf).select("entity_id", X.base_clean(F.col("business_name")).alias("name"), X.base_clean(F.col("business_address")).alias("addr"))


@query("text_fold_documents", "select doc_id, md5(lower(strip_accents(regexp_replace(text, '[^\\x00-\\x7FÀ-ÖØ-öø-ÿ]', '', 'g')))) as folded from documents")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    # whole texts; the SQL folds what is left of them without other scripts and signs
    return d.select("doc_id", F.md5(X.folded_exactly(F.col("text"))).alias("folded"))


@query("text_skeleton", f"select distinct w, {_skel('w')} as sk from (select unnest(regexp_extract_all(lower(p_name), '[a-z]+')) as w from part)")
def _(spark, sf):
    w = spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct()
    return w.select("w", X.skeleton(F.col("w")).alias("sk"))


@query(
    "text_street_words",
    rf"""with a as (select entity_id, list_filter(string_split({_fold("business_address")}, ','), lambda x: regexp_matches(x, '\d'))[1] as part from ({FX.RECORDS}))
    select entity_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(coalesce(part, ''), '\d+[a-z]?', ' ', 'g'), '[a-z]{{2,}}'), lambda x: x not in {_in(T.STREET_DROP)}), ' ') as stw from a""",
)
def _(spark, sf):
    return FX.records(spark, sf).select("entity_id", F.array_join(X.street_words(F.col("business_address")), " ").alias("stw"))


@query("normalise", f"{_RECS} select entity_id, country, noaddr, {_dj('nw', 'core', 'alias', 'legal', 'sk', 'aw', 'ad')} from n")
def _(spark, sf):
    return _nrec(spark, sf).select("entity_id", "country", "noaddr", *map(_j, ("nw", "core", "alias", "legal", "sk", "aw", "ad")))


@query("text_sorted_bag", f"{_RECS} select entity_id, array_to_string(list_sort(list_filter(string_split(array_to_string(core, ''), ''), lambda x: x <> '')), '') as bag from n")
def _(spark, sf):
    return _nrec(spark, sf).select("entity_id", X.sorted_bag(F.col("core")).alias("bag"))


# ---- blocking ----------------------------------------------------------------------------------------------------


def _tag(p: str, a: str) -> str:
    return f"list_transform({a}, lambda x: '{p}' || x)"


def _pairs(p: str, a: str) -> str:
    return f"flatten(list_transform({a}, lambda x, i: list_transform(({a})[i + 1:], lambda y: '{p}' || least(x, y) || '|' || greatest(x, y))))"


def _cross(p: str, a: str, b: str) -> str:
    return f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: '{p}' || x || '|' || y)))"


def _win(a: str, n: int) -> str:
    return f"list_distinct(list_concat({a}[1:{n}], {a}[-3:]))"


def _cat(*a: str) -> str:
    out = a[0]
    for x in a[1:]:
        out = f"list_concat({out}, {x})"
    return out


def _longs(a: str) -> str:
    return f"list_filter({a}, lambda x: length(x) > 3)"


_KEY = "array_to_string(list_sort(core), ' ')"
_GRAM = "('^' || array_to_string(core[1:2], '') || '$')"
_PLAIN0 = _longs(_cat(_tag("n:", "core"), _tag("k:", "sk"), _tag("a:", "aw"), _tag("#:", "ad"), _tag("u:", "au")))


def _arms(q: bool) -> dict[int, str]:
    combos = [_cross("x:", "ad[1:2]", _win("aw", 6)), _pairs("w:", "aw[1:5]"), _cross("y:", "core[1:3]", _win("aw", 4))]
    if q:
        cut = "flatten(list_transform(list_filter(ad[1:2], lambda x: length(x) >= 3), lambda x: [substr(x, 2), substr(x, 1, length(x) - 1)]))"
        combos.append(_cross("x:", cut, _win("aw", 6)))
    keys = f"case when len(core) > 0 then list_concat(['N:' || array_to_string(list_sort(core), ' '), 'C:' || array_to_string(core, ''), 'C:' || array_to_string(core[1:2], '')], case when len(sk) > 0 then ['K:' || array_to_string(list_sort(sk), ' ')] else [] end) else [] end"
    bare = _longs(_cat(_tag("z:", "core"), _tag("zk:", "sk")))
    k8 = f"case when length({_KEY}) >= 3 then list_concat(list_transform(({_once('ad')})[1:4], lambda x: 'K#:' || {_KEY} || '|' || x), list_transform({_win('aw', 8)}, lambda x: 'Kw:' || {_KEY} || '|' || x)) else [] end"
    return {
        0: _cat(_PLAIN0, *combos),
        3: _longs(_pairs("p:", "core[1:4]")),
        4: _longs(keys),
        5: _longs(_cat(_tag("m:", "core"), _tag("q:", "sk"), _tag("m:", "alias"))),
        6: f"case when length({_GRAM}) >= 5 then list_transform(range(1, length({_GRAM}) - 1), lambda i: 't:' || substr({_GRAM}, i, 3)) else [] end",
        7: bare if q else f"case when noaddr then {bare} else [] end",
        8: k8,
    }


def _tok(src: str, q: bool, only=None) -> str:
    return " union all ".join(f"select country, entity_id as id, {k} as arm, unnest(list_distinct({v})) as t from {src}" for k, v in _arms(q).items() if only is None or k in only)


for _k in (0, 3, 4, 5, 6, 7, 8):

    def _arm(spark, sf, k=_k):
        return blocking.tokens(_nrec(spark, sf), only=[k]).select("id", "t")

    query(f"block_arm{_k}", f"{_RECS} select id, t from ({_tok('n', False, [_k])})")(_arm)


@query("block_query_tokens", f"with {_norm(FX.S1, 'n')} select id, arm, t from ({_tok('n', True, [0, 7])})")
def _(spark, sf):
    return blocking.tokens(_nq(spark, sf), query=True, only=[0, 7]).select("id", "arm", "t")


_CAP = " ".join(f"when {k} then {v}" for k, v in blocking.CAPS.items())
_INDEX = f"""{_BOTH},
ix as ({_tok("n", False)}), qx as ({_tok("q", True)}),
cnt as (select country, count(*) as n_records from n group by country),
dfc as (select country, arm, t, count(*) as df from ix group by all having count(*) <= case when arm = 4 then {blocking.KEY_CAP} else {blocking.DF_CAP} end),
wt as (select dfc.*, cast(round_even((ln(n_records) - ln(df)) * 1024, 0) as bigint) as idf from dfc join cnt using (country)),
sc as (select qx.id as s1, ix.id as r, arm, sum(idf)::bigint as sc from qx join wt using (country, arm, t) join ix using (country, arm, t) group by all),
rk as (select *, row_number() over (partition by s1, arm order by sc desc, r) as rk from sc),
kept as (select * from rk where rk <= case arm {_CAP} end),
pool as (select s1, r, coalesce(max(sc) filter (arm = 0), 0)::bigint as sc, min(rk) filter (arm = 0) as prk, min(rk) filter (arm <> 0) as xrk, bool_or(arm = 0) as a0, bool_or(arm = 4) as a4, bool_or(arm = 5) as a5 from kept group by all)"""


def _parts(spark, sf):
    """Index and queries of all arms, with units and the default caps."""
    r, q = _nrec(spark, sf), _nq(spark, sf)
    ix, qx = blocking.tokens(r), blocking.tokens(q, True)
    return r, q, ix, qx, blocking.idf(ix, r)


def _lists(spark, sf):
    """(s1, arm, hits) of all queries."""
    return blocking.retrieve_records(*_stored(spark, sf))


def _pool(spark, sf):
    return blocking.pool(blocking.unpacked(_lists(spark, sf)))


@query("block_index", f"{_INDEX} select country, arm, t, df, idf from wt")
def _(spark, sf):
    return _parts(spark, sf)[4]


@query("block_retrieve", f"{_INDEX} select s1, r, arm, sc, rk from kept")
def _(spark, sf):
    return blocking.unpacked(_lists(spark, sf)).withColumn("rk", F.col("rk").cast("long"))


@query("block_pool", f"{_INDEX} select s1, r, sc, prk, xrk, a0, a5 from pool")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).select("s1", "r", "sc", F.col("prk").cast("long").alias("prk"), F.col("xrk").cast("long").alias("xrk"), "a0", "a5")


_SIG = """sig as (select * from (select country, entity_id as r, case when length(array_to_string(list_distinct(ad), '')) >= 3 then '#' || array_to_string(list_sort(list_distinct(ad)), ' ')
   when len(sk) >= 2 then 'k' || array_to_string(list_sort(sk), ' ') end as sig from n) where sig is not null)"""


@query("block_signatures", f"{_RECS}, {_SIG} select * from sig")
def _(spark, sf):
    return blocking.signatures(_nrec(spark, sf))


@query(
    "block_expand",
    f"""{_INDEX}, {_SIG}, small as (select * from (select *, count(*) over (partition by country, sig) as n from sig) where n <= 12),
    hit as (select distinct s1, country, sig from pool join small using (r) where prk <= 10)
    select distinct s1, small.r from hit join small using (country, sig) where not exists (select 1 from pool p where p.s1 = hit.s1 and p.r = small.r)""",
)
def _(spark, sf):
    return blocking.expand(_pool(spark, sf), blocking.signatures(_nrec(spark, sf)))


_REL = """case when len(x) = 0 or len(y) = 0 then 'missing' when len(list_intersect(x, y)) = len(x) and len(x) = len(y) then 'equal'
  when len(list_intersect(x, y)) in (len(x), len(y)) then 'subset' when len(list_intersect(x, y)) > 0 then 'overlap'
  when len(list_filter(flatten(list_transform(x, lambda p: list_transform(y, lambda q: abs(length(p) - length(q)) = 1 and greatest(length(p), length(q)) >= 3 and
     (starts_with(p, q) or ends_with(p, q) or starts_with(q, p) or ends_with(q, p))))), lambda b: b)) > 0 then 'trunc' else 'disjoint' end"""
_PAIRS = f"""{_BOTH}, p as (select q.entity_id as s1, n.entity_id as r, q.nw nw_s, n.nw nw_r, q.core core_s, n.core core_r, q.sk sk_s, n.sk sk_r, q.aw aw_s, n.aw aw_r, q.legal legal_s, n.legal legal_r,
  q.ad as ad_s, n.ad as ad_r, list_distinct(q.ad) as x, list_distinct(n.ad) as y from q join n on q.k // 8 = cast(substr(n.entity_id, 4) as bigint) // 10 // 8)"""


def _pairs_df(spark, sf):
    return features.sided(FX.scored(spark, sf).select("s1", "r"), _nq(spark, sf), _nrec(spark, sf))


@query("number_relation", f"{_PAIRS} select s1, r, {_REL} as rel from p")
def _(spark, sf):
    return _pairs_df(spark, sf).select("s1", "r", blocking.number_relation(F.col("ad_s"), F.col("ad_r")).alias("rel"))


def _dup(x: str) -> str:
    return f"round(len(list_intersect({x}_s, {x}_r)) / greatest(len(list_distinct({x}_s)), len(list_distinct({x}_r)), 1)::double, 6) as"


@query(
    "set_features",
    f"""{_PAIRS} select s1, r, len(core_s)::bigint as n_core_s, len(core_r)::bigint as n_core_r, abs(length(array_to_string(nw_s, ' ')) - length(array_to_string(nw_r, ' ')))::bigint as len_diff,
    starts_with(r, 'S3') as src_s3, len(list_intersect(core_s, core_r))::bigint as n_core_common, len(list_filter(core_r, lambda t: not list_contains(core_s, t)))::bigint as n_extra_r,
    {_dup("sk")} sk_jacc, {_dup("nw")} nw_jacc, {_dup("aw")} aw_jacc, {_dup("ad")} num_jacc,
    case when len(legal_s) = 0 or len(legal_r) = 0 then 2 when len(list_intersect(legal_s, legal_r)) > 0 then 0 else 1 end as legal_rel,
    case when ad_s[1] is null or ad_r[1] is null then 5 when ad_s[1] = ad_r[1] then 0
      when abs(length(ad_s[1]) - length(ad_r[1])) = 1 and (starts_with(ad_s[1], ad_r[1]) or ends_with(ad_s[1], ad_r[1]) or starts_with(ad_r[1], ad_s[1]) or ends_with(ad_r[1], ad_s[1])) then 1
      when abs(ad_s[1]::bigint - ad_r[1]::bigint) <= 25 then 2 when levenshtein(ad_s[1], ad_r[1]) = 1 then 3 else 4 end as house_rel from p""",
)
def _(spark, sf):
    cols = "s1 r n_core_s n_core_r len_diff src_s3 n_core_common n_extra_r sk_jacc nw_jacc aw_jacc num_jacc legal_rel house_rel".split()
    return features.set_features(_pairs_df(spark, sf)).select(*cols)


# ---- scored pairs ------------------------------------------------------------------------------------------------

_S = f"with d as ({FX.scored_sql('duck')}), gt as ({FX.TRUTH}), qs as (select entity_id as s1 from ({FX.S1}))"
_OD = "(least(p, 1 - 1e-6) / (1 - least(p, 1 - 1e-6)))"
_RANKED = ", rk as (select *, row_number() over (partition by s1 order by p desc, r) as rk from d)"
_SEL = _RANKED + ", sel as (select s1, r, p from rk where p > case when rk = 1 then .8 else .75 end)"


def _qs(spark, sf):
    return FX.s1(spark, sf).select(F.col("entity_id").alias("s1"))


def _sel(spark, sf):
    return decide.rank_threshold(FX.scored(spark, sf), 0.8, 0.75).select("s1", "r", "p")


@query("reverse_margin", f"{_S} select s1, r, round(coalesce((sc - m) / nullif(m, 0)::double, 0), 9) as rev_margin from (select *, max(sc) over (partition by r) as m from d)")
def _(spark, sf):
    return blocking.reverse_margin(FX.scored(spark, sf)).select("s1", "r", F.round("rev_margin", 9).alias("rev_margin"))


@query(
    "prune",
    f"""{_S}, a as (select *, max(sc) over (partition by s1, gid) as gs, max(sc) over (partition by s1) as top from d),
    b as (select *, dense_rank() over (partition by s1 order by gs desc, gid) as grk from a),
    c as (select *, row_number() over (partition by s1 order by sc desc, r) as k from b where gs >= top * .5 and grk <= 3) select s1, r from c where k <= 10""",
)
def _(spark, sf):
    return blocking.prune(FX.scored(spark, sf), 0.5, 3, None, 10).select("s1", "r")


@query("context_features", f"{_S} select s1, r, round(coalesce(sc / nullif(max(sc) over (partition by s1), 0)::double, 0), 6) as sc_ratio, row_number() over (partition by s1 order by sc desc, r) as sc_rank, count(*) over (partition by s1) as n_cands from d")
def _(spark, sf):
    return features.context_features(FX.scored(spark, sf)).select("s1", "r", "sc_ratio", F.col("sc_rank").cast("long").alias("sc_rank"), "n_cands")


@query("claim_features", f"{_S}, b as (select *, max(sc) over (partition by r) as m from d) select s1, r, count(*) over (partition by r) as n_claimants, sum(case when sc >= .95::double * m then 1 else 0 end) over (partition by r)::bigint as n_claim from b")
def _(spark, sf):
    return features.claim_features(FX.scored(spark, sf)).select("s1", "r", "n_claimants", "n_claim")


@query("name_frequency", f"with {_norm(FX.S1, 'n')} select entity_id, count(*) over (partition by country, array_to_string(list_sort(core), ' ')) as s1_name_freq from n")
def _(spark, sf):
    return features.name_frequency(_nq(spark, sf))


@query("exclusive_posterior", f"{_S} select s1, r, round({_OD} / (1 + sum({_OD}) over (partition by r)), 6) as q from d")
def _(spark, sf):
    return decide.exclusive_posterior(FX.scored(spark, sf)).select("s1", "r", F.round("q", 6).alias("q"))


@query("rank_threshold", f"{_S}{_SEL} select * from sel")
def _(spark, sf):
    return _sel(spark, sf)


@query("country_thresholds", f"{_S}{_RANKED} select s1, r from rk where p > case when rk = 1 then case when country = 'US' then .85 else .92 end else case when country = 'US' then .8 else .9 end end")
def _(spark, sf):
    us = F.col("country") == "US"
    return decide.rank_threshold(FX.scored(spark, sf), F.when(us, 0.85).otherwise(0.92), F.when(us, 0.8).otherwise(0.9)).select("s1", "r")


@query(
    "source_caps",
    f"""{_S}, a as (select *, row_number() over (partition by s1, substr(r, 1, 2) order by p desc, r) as k from d),
    b as (select *, row_number() over (partition by s1 order by p desc, r) as k2 from a where k <= case when substr(r, 1, 2) = 'S2' then 5 else 6 end) select s1, r from b where k2 <= 11""",
)
def _(spark, sf):
    return decide.source_caps(FX.scored(spark, sf)).select("s1", "r")


@query("one_owner", f"{_S} select s1, r, p from (select *, row_number() over (partition by r order by p desc, s1) as k from d) where k = 1")
def _(spark, sf):
    return decide.one_owner(FX.scored(spark, sf)).select("s1", "r", "p")


@query("closure", f"{_S}, a as (select s1 from qs where s1 like '%7') select distinct s1 from d where r in (select r from d where s1 in (select s1 from a))")
def _(spark, sf):
    return decide.closure(FX.scored(spark, sf), _qs(spark, sf).filter("s1 like '%7'"))


_PERQ = """, b as (select coalesce(x.s1, g.s1) as s1, x.r is not null and g.r is not null as hit, x.r is not null as a, g.r is not null as t from sel x full join gt g on x.s1 = g.s1 and x.r = g.r),
n as (select s1, count(*) filter (hit) as tp, count(*) filter (a) as np, count(*) filter (t) as nt from b group by s1),
pq as (select qs.s1, coalesce(tp, 0) as tp, coalesce(np, 0) as np, coalesce(nt, 0) as nt from qs left join n using (s1)),
pf as (select *, round(case when np = 0 and nt = 0 then 1.0 when tp = 0 then 0.0 else 1.25e0 * tp / (.25e0 * nt + np) end, 9)::double as f from pq)"""
_MACRO = "select round(avg(f), 6) as f05, round(avg(f) filter (nt = 0), 6) as f05_single, round(avg(f) filter (nt > 0), 6) as f05_other, round(sum(tp) / sum(np), 6) as precision, round(sum(tp) / sum(nt), 6) as recall from pf"


@query("f_per_query", f"{_S}{_SEL}{_PERQ} select * from pf")
def _(spark, sf):
    return metrics.per_query(_sel(spark, sf), FX.truth(spark, sf), _qs(spark, sf))


@query("macro_f", f"{_S}{_SEL}{_PERQ} {_MACRO}")
def _(spark, sf):
    return metrics.macro_f(_sel(spark, sf), FX.truth(spark, sf), _qs(spark, sf))


@query("ceiling", f"{_S}, sel as (select d.s1, d.r from d join gt on d.s1 = gt.s1 and d.r = gt.r){_PERQ} {_MACRO}")
def _(spark, sf):
    return metrics.ceiling(FX.scored(spark, sf), FX.truth(spark, sf), _qs(spark, sf))


@query(
    "pool_recall",
    f"""{_INDEX}, gt as ({FX.TRUTH}), h as (select gt.s1, count(*) as nt, count(pool.r) as tp from gt left join pool on gt.s1 = pool.s1 and gt.r = pool.r group by gt.s1),
    c as (select s1, count(*) as n from pool group by s1), e as (select coalesce(nt, 0) as nt, coalesce(tp, 0) as tp, coalesce(c.n, 0) as n from q left join h on q.entity_id = h.s1 left join c on q.entity_id = c.s1)
    select round(sum(tp) / sum(nt), 6) as pair_recall, round(avg(case when nt = tp then 1.0 else 0.0 end), 6) as complete, round(avg(n), 6) as cands, round(quantile_cont(n, .95), 6) as p95 from e""",
)
def _(spark, sf):
    rs = F.array_distinct(F.flatten(F.collect_list(F.col("hits")["r"])))
    return metrics.list_recall(_lists(spark, sf).groupBy("s1").agg(rs.alias("rs")), FX.truth(spark, sf), _qs(spark, sf))


@query("attribution", f"{_S}{_SEL}, m as (select * from gt where not exists (select 1 from sel where sel.s1 = gt.s1 and sel.r = gt.r)) select case when not exists (select 1 from d where d.s1 = m.s1 and d.r = m.r) then 'not_in_pool' when m.r in (select r from sel) then 'other_owner' else 'threshold' end as bucket, count(*) as n from m group by 1")
def _(spark, sf):
    s = _sel(spark, sf)
    return metrics.attribution(s, FX.scored(spark, sf), FX.truth(spark, sf), s)


@query("competition", f"""{_S}, o as (select *, round({_OD}, 9) as o from d), t as (select *, sum(o) over (partition by r) as tot from o)
    select s1, r, count(*) over (partition by r) as n_r, row_number() over (partition by r order by p desc, s1) as rk_r, row_number() over (partition by s1 order by p desc, r) as rk_s,
    round(sum(p) over (partition by s1), 4) as psum_s, round(o / tot, 6) as share_r, round(o / (.5 + tot), 6) as q05 from t""")
def _(spark, sf):
    c = compete.competition(FX.scored(spark, sf))
    return c.select("s1", "r", "n_r", F.col("rk_r").cast("long").alias("rk_r"), F.col("rk_s").cast("long").alias("rk_s"), F.round("psum_s", 4).alias("psum_s"), "share_r", "q05")


@query("s1_aggregate", f"{_S}{_RANKED} select s1, max(p) filter (rk = 1) as p1, coalesce(max(p) filter (rk = 2), 0) as p2, round(sum(p), 4) as psum, count(*) filter (p > .5) as n05, count(*) as nc from rk group by s1")
def _(spark, sf):
    return model.s1_aggregate(FX.scored(spark, sf)).withColumn("psum", F.round("psum", 4))


@query("folds", f"select entity_id, cast('0x' || substr(md5(entity_id), 1, 8) as bigint) % 100 as fold from ({FX.S1})")
def _(spark, sf):
    return FX.s1(spark, sf).select("entity_id", model.fold(F.col("entity_id")).alias("fold"))


@query("truth_pairs", f"with l as (select s1, string_agg(r, ',') as x from ({FX.TRUTH}) group by s1) select s1, unnest(string_split(x, ',')) as r from l")
def _(spark, sf):
    t = FX.truth(spark, sf).groupBy("s1").agg(F.array_join(F.collect_list("r"), ",").alias("matched_entity_ids"))
    return io.truth_pairs(t.withColumnRenamed("s1", "source1_entity_id"))


@query("id_lists", f"{_S}{_SEL} select qs.s1 as source1_entity_id, coalesce(string_agg(r, ',' order by r), '') as matched_entity_ids from qs left join sel using (s1) group by qs.s1")
def _(spark, sf):
    return io.id_lists(_sel(spark, sf), _qs(spark, sf), "matched_entity_ids")


@query("violations", f"{_S}{_SEL} select 'duplicate_query' as rule, 0::bigint as n union all select 'duplicate_match', 0 union all select 'wrong_prefix', 0 union all select 'self_match', 0 union all select 'unknown_record', 0 union all select 'unknown_query', 0 union all select 'not_a_candidate', (select count(*) from sel where not exists (select 1 from d where d.s1 = sel.s1 and d.r = sel.r and d.p < .9))")
def _(spark, sf):
    d = FX.scored(spark, sf)
    return io.violations(_sel(spark, sf), d.filter("p < 0.9"), _qs(spark, sf), FX.records(spark, sf)).select("rule", "n")


# ---- artefacts ---------------------------------------------------------------------------------------------------


@query("vocabulary", f"{_RECS} select country, t as token, count(*) as n from (select country, unnest(nw) as t from n) group by all having count(*) >= 2")
def _(spark, sf):
    return artifacts.vocabulary(_nrec(spark, sf))


@query(
    "equivalences",
    f"""{_BOTH}, d as (select list_filter(q.aw, lambda t: not list_contains(n.aw, t)) as x, list_filter(n.aw, lambda t: not list_contains(q.aw, t)) as y from q join n on q.k = n.k),
    e as (select * from d where len(x) between 1 and 3 and len(y) between 1 and 3), u as (select unnest(x) as x, y from e), ab as (select x, unnest(y) as y from u),
    nx as (select unnest(x) as x, 1 from e), cx as (select x, count(*) as nx from nx group by x), ny as (select unnest(y) as y from e), cy as (select y, count(*) as ny from ny group by y),
    g as (select x, y, count(*) as n_ab from ab group by x, y), f as (select g.* from g join cx using (x) join cy using (y) where n_ab >= 3 and greatest(n_ab / nx, n_ab / ny) >= .5 and least(n_ab / nx, n_ab / ny) >= .1)
    select token, equiv, max(n_ab) as n_ab from (select x as token, y as equiv, n_ab from f union all select y, x, n_ab from f) group by all""",
)
def _(spark, sf):
    p = _nq(spark, sf).select("k", F.col("aw").alias("a")).join(_nrec(spark, sf).select("k", F.col("aw").alias("b")), "k")
    return artifacts.equivalences(p, min_n=3)


@query("lexicon", f"{_BOTH}, z as (select unnest(q.core) as a, unnest(n.core) as b from q join n on q.k = n.k where len(q.core) = len(n.core)), c as (select a, b, count(*) as n from z group by all), s as (select a as indic, b as latin, n, round(n / sum(n) over (partition by a), 6) as share, row_number() over (partition by a order by n desc, b) as k from c) select indic, latin, n, share from s where k = 1 and n >= 3 and share >= .6")
def _(spark, sf):
    p = _nq(spark, sf).select("k", F.col("core").alias("a")).join(_nrec(spark, sf).select("k", F.col("core").alias("b")), "k")
    return artifacts.indic_lexicon(p)


@query("pseudo_pairs", f"{_BOTH} select q.entity_id as s1, n.entity_id as r from q join n on q.country = n.country and q.ad[1] = n.ad[1] and list_sort(q.core) = list_sort(n.core) and len(q.core) > 0 where list_sort(list_distinct(q.ad)) = list_sort(list_distinct(n.ad)) and len(list_intersect(q.aw, n.aw)) >= 3")
def _(spark, sf):
    return artifacts.pseudo_pairs(_nq(spark, sf), _nrec(spark, sf))


@query("alias_sides", f"{_BOTH}, p as (select len(list_intersect(q.core, n.alias)) as a, len(list_intersect(q.core, n.core)) as m from q join n on q.k = n.k where len(n.alias) > 0) select count(*) as n, round(avg(case when m > a then 1.0 else 0.0 end), 6) as main_better, round(avg(case when a > m then 1.0 else 0.0 end), 6) as alias_better from p")
def _(spark, sf):
    p = _nq(spark, sf).select("k", F.col("core").alias("core_s")).join(_nrec(spark, sf).select("k", F.col("core").alias("core_r"), F.col("alias").alias("alias_r")), "k")
    return artifacts.alias_sides(p)


@query("extra_words", f"{_BOTH}, a as (select entity_id as s1, country, list_sort(nw) as k from q where len(nw) <= 8), b0 as (select entity_id as r, country, nw, unnest(nw) as t from n where len(nw) <= 9), b as (select r, country, t, list_sort(list_filter(nw, lambda x: x <> t)) as k from b0), gt as ({FX.TRUTH}) select t, count(gt.s1) as n_true, count(*) - count(gt.s1) as n_other from a join b on a.country = b.country and a.k = b.k left join gt on gt.s1 = a.s1 and gt.r = b.r group by t")
def _(spark, sf):
    return artifacts.extra_words(_nq(spark, sf), _nrec(spark, sf), FX.truth(spark, sf))


# ---- beyond SQL --------------------------------------------------------------------------------------------------


@query("embedding_arm", """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
    s as (select a.vec_id as s1, b.vec_id as r, round(list_cosine_similarity(a.v, b.v), 6) as esim from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
    k as (select *, row_number() over (partition by s1 order by esim desc, r) as erk from s) select s1, r, esim, erk from k where erk <= 20""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/embeddings.parquet")
    return blocking.cosine_topk(d, F.col("vec_id") % 50 == 0, 20).select("s1", "r", "esim", F.col("erk").cast("long").alias("erk"))


@query("string_features", f"{_PAIRS} select s1, r, round(jaro_winkler_similarity(array_to_string(core_s, ' '), array_to_string(core_r, ' ')), 6) as co_jw from p")
def _(spark, sf):
    return features.string_features(_pairs_df(spark, sf)).select("s1", "r", F.round("co_jw", 6).alias("co_jw"))


@query("expected_f_decode")
def _(spark, sf):
    return decide.expected_f_decode(FX.scored(spark, sf)).select("s1", "r", "p")


@query("street_filter")
def _(spark, sf):
    return decide.street_filter(_sel(spark, sf), _nq(spark, sf), _nrec(spark, sf))


@query("siblings")
def _(spark, sf):
    t = _nrec(spark, sf).select(F.col("entity_id").alias("r"), F.array_join("aw", " ").alias("addr"), F.array_join("nw", " ").alias("name"))
    return compete.siblings(FX.scored(spark, sf).select("s1", "r", "p"), t)


@query("threshold_grid")
def _(spark, sf):
    return decide.tune(FX.scored(spark, sf), FX.truth(spark, sf), _qs(spark, sf), [(a / 10, b / 10) for a in range(5, 10) for b in range(5, 10)])


@query("matcher")
def _(spark, sf):
    d = features.context_features(FX.scored(spark, sf)).select("s1", "r", "sc", "sc_ratio", "sc_rank", "n_cands")
    d = features.set_features(features.sided(d, _nq(spark, sf), _nrec(spark, sf)))
    cols = ["sc_ratio", "sc_rank", "sk_jacc", "nw_jacc", "aw_jacc", "num_jacc", "house_rel", "num_rel", "len_diff"]
    d = d.join(FX.truth(spark, sf).withColumn("y", F.lit(1)), ["s1", "r"], "left").withColumn("y", F.coalesce("y", F.lit(0))).select("s1", "r", "y", *cols)
    d = cut(d)  # read by the fit and by the prediction
    return model.predict(model.fit_matcher(d, cols), d, cols).select("s1", "r", "y", "p")
