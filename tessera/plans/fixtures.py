"""Record tables derived from customer, part and region, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

S1 = """select 'S1-' || lpad(cast(c_custkey as string), 9, '0') as entity_id,
       p_name || ' ' || lower(c_mktsegment) || ' ' ||
         split_part('LLC,Inc,Pvt Ltd,Limited,SARL,Company', ',', cast(c_custkey % 6 as int) + 1) as business_name,
       cast(100 + (c_custkey * 37) % 900 as string) || ' ' ||
         split_part('Oak,Park,Main,Lake,Hill,Nehru,Victor Hugo,Station', ',', cast(c_custkey % 8 as int) + 1) || ' ' ||
         split_part('Street,Road,Avenue,Rue', ',', cast(c_custkey % 4 as int) + 1) || ', ' ||
         split_part('Dayton,Salem,Auburn,Pune,Jaipur,Kochi,Nantes,Calais', ',', cast(c_nationkey % 8 as int) + 1) as business_address,
       split_part('US,India,France', ',', cast(c_custkey % 3 as int) + 1) as country,
       c_custkey as k
from customer join part on p_partkey = c_custkey"""

RECORDS = """with s1 as ( {s1} ),
cp as (select s1.*, r_regionkey as j, cast((k * 7 + r_regionkey * 3) % 9 as int) as m
       from s1 cross join region where (k + r_regionkey) % 3 <> 0 and r_regionkey < 4 and k % 18 <> 5),
copies as (
 select (case when j < 2 then 'S2-' else 'S3-' end) || lpad(cast(k * 10 + j as string), 9, '0') as entity_id,
   case m when 0 then business_name || ' # ' || cast(k as string) || ' (id ' || cast(k as string) || ')'
          when 1 then upper(business_name)
          when 2 then replace(replace(business_name, ' LLC', ''), ' Inc', '')
          when 3 then replace(business_name, 'i', '1')
          when 4 then 'Zarqo F/K/A ' || business_name
          when 5 then replace(business_name, 'e', 'é')
          when 6 then replace(business_name, ' ', '') || '.com'
          else business_name end as business_name,
   case m when 6 then 'None' when 7 then substr(business_address, 2)
          when 8 then replace(replace(business_address, 'Street', 'St'), 'Road', 'Rd')
          when 2 then upper(business_address) else business_address end as business_address,
   country, k from cp),
decoys as (
 select 'S3-' || lpad(cast(k * 10 + 9 as string), 9, '0') as entity_id,
   replace(business_name, ' ', ' group ') as business_name,
   cast(100 + (k * 37 + 7) % 900 as string) || substr(business_address, 4) as business_address,
   country, cast(null as bigint) as k from s1 where k % 4 = 1)
select * from copies union all select * from decoys""".replace("{s1}", S1)

TRUTH = f"select s.entity_id as s1, r.entity_id as r from ({RECORDS}) r join ({S1}) s on r.k = s.k"

#: candidates with a pseudo-probability from the md5 of both ids
_HASH = {
    "spark": "cast(conv(substr(md5(s.entity_id || r.entity_id), 1, 8), 16, 10) as bigint)",
    "duck": "cast('0x' || substr(md5(s.entity_id || r.entity_id), 1, 8) as bigint)",
}


def scored_sql(engine: str) -> str:
    h, div = _HASH[engine], "div" if engine == "spark" else "//"
    return f"""select s.entity_id as s1, r.entity_id as r, s.country, round(({h} % 1000 + 0.5) / 1000.0e0, 4) as p, {h} % 5000 as sc, {h} % 7 as prk, 'g' || cast({h} % 4 as string) as gid
      from ({S1}) s join ({RECORDS}) r on s.k {div} 8 = cast(substr(r.entity_id, 4) as bigint) {div} 10 {div} 8"""


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in ("customer", "part", "region"):
        sql = re.sub(rf"\b{t}\b", "{" + t + "}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "part", "region") if "{" + t + "}" in sql})


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, S1)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, RECORDS)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, TRUTH)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, scored_sql("spark"))
