"""Record sources, ground truth, the submission sink and its validator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Tab-separated records of one or more files, all strings, no quoting."""
    return spark.read.csv(list(paths), sep="\t", quote="", header=True, schema=RECORD)


def truth_pairs(rows: DataFrame) -> DataFrame:
    """(s1, r) from rows with comma lists; empty and null lists give none."""
    d = rows.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split("matched_entity_ids", ",")).alias("r"))
    return d.withColumn("r", F.trim("r")).filter("r <> ''")


def id_lists(pairs: DataFrame, queries: DataFrame, name: str) -> DataFrame:
    """One row per query with its sorted ids, comma-joined; empty where it has none."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias(name))
    return queries.select("s1").join(lists, "s1", "left").select(F.col("s1").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def write_submission(
    matches: DataFrame, candidates: DataFrame, queries: DataFrame, records: DataFrame, match_path: str, candidate_path: str, one_file: bool = False
) -> None:
    """Both lists as TSV after the checks of ``violations``; raises where one fails. ``one_file`` writes one file to each path, else folders."""
    bad = violations(matches, candidates, queries, records).filter("n > 0").collect()  # a row per rule
    if bad:
        raise ValueError(f"invalid submission: {bad}")
    for pairs, name, path in ((matches, "matched_entity_ids", match_path), (candidates, "candidate_entity_ids", candidate_path)):
        rows = id_lists(pairs, queries, name).orderBy("source1_entity_id")
        if one_file:
            write_one(rows, path)
        else:
            rows.write.csv(path, sep="\t", quote="", header=True, mode="overwrite", emptyValue="")


def write_one(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """``rows`` as a single file with a header, written by one task beside the path and renamed there."""
    spark = rows.sparkSession
    rows.coalesce(1).write.csv(f"{path}.parts", sep=sep, quote="", header=True, mode="overwrite", emptyValue="")
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder, to = hadoop.Path(f"{path}.parts"), hadoop.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    fs.delete(to, True)
    fs.rename(part, to)
    fs.delete(folder, True)


def write_metrics(rows: DataFrame, path: str) -> None:
    """A small table of figures as one CSV file."""
    write_one(rows, path, ",")


def write_by(rows: DataFrame, path: str, *by: str) -> None:
    """Parquet folders by the values of columns, a file or a few for each."""
    rows.repartition(*by).write.partitionBy(*by).mode("overwrite").parquet(path)


def file_violations(spark: SparkSession, path: str, list_name: str, queries: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(rule, n, first and last example) of a written list of ids: header, tabs, rows of a query, ids in a list, prefixes, queries left out or unknown.

    With ``records`` ids must exist as well. Rows that are no rows at all count under their own rule and no other.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    # the smallest line number is the header's: of the first file of a folder, whose other files have their own, which are no rows
    head = F.lower(F.col("value")) == F.lit(f"source1_entity_id\t{list_name}")
    first = lines.agg(F.min_by("value", "at").alias("value"))
    body = lines.join(F.broadcast(lines.agg(F.min("at").alias("top")))).filter((F.col("at") != F.col("top")) & ~head).drop("at", "top")
    has_tab = F.instr("value", "\t") > 0
    rows = body.filter(has_tab).select(F.substring_index("value", "\t", 1).alias("s1"), F.split(F.substring("value", F.instr("value", "\t") + 1, F.length("value")), ",").alias("ids"))
    rows = rows.withColumn("ids", F.when((F.size("ids") == 1) & (F.trim(F.col("ids")[0]) == ""), F.array().cast("array<string>")).otherwise(F.col("ids")))
    each = rows.select("s1", F.explode(F.array_distinct("ids")).alias("r"))
    comma = first.filter((F.instr("value", "\t") == 0) & (F.instr("value", ",") > 0))
    out = [
        _rule("comma_separated", comma, "value"),
        _rule("header", first.filter(~head).join(comma, "value", "left_anti"), "value"),
        _rule("no_tab", body.filter(~has_tab & (F.trim("value") != "")), "value"),
        _rule("duplicate_row", rows.groupBy("s1").count().filter("count > 1"), "s1"),
        _rule("duplicate_id", rows.filter(F.size("ids") != F.size(F.array_distinct("ids"))), "s1"),
        _rule("self_match", each.filter(F.col("r").startswith("S1-")).select("r").distinct(), "r"),
        _rule("wrong_prefix", each.filter(~F.col("r").rlike("^S[123]-")).select("r").distinct(), "r"),
        _rule("missing_query", queries.select("s1").join(rows, "s1", "left_anti"), "s1"),
        _rule("unknown_query", rows.join(queries, "s1", "left_anti").select("s1").distinct(), "s1"),
    ]
    if records is not None:
        known = records.select(F.col("entity_id").alias("r"))
        out.append(_rule("unknown_record", each.filter(F.col("r").rlike("^S[23]-")).join(known, "r", "left_anti").select("r").distinct(), "r"))
    done = out[0]
    for d in out[1:]:
        done = done.unionByName(d)
    return done


def _rule(name: str, bad: DataFrame, col: str) -> DataFrame:
    return bad.agg(F.lit(name).alias("rule"), F.count("*").alias("n"), F.array_compact(F.array(F.min(F.substring(F.col(col).cast("string"), 1, 200)), F.max(F.substring(F.col(col).cast("string"), 1, 200)))).alias("examples"))


def violations(matches: DataFrame, candidates: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """(rule, n, examples): counts and the first and last example of each broken rule, all rules in one plan."""

    known = records.select(F.col("entity_id").alias("r"))
    out = [
        _rule("duplicate_query", queries.groupBy("s1").count().filter("count > 1"), "s1"),
        _rule("duplicate_match", matches.groupBy("s1", "r").count().filter("count > 1"), "r"),
        _rule("wrong_prefix", matches.filter(~F.col("r").rlike("^S[23]-")), "r"),
        _rule("self_match", matches.filter("s1 = r"), "r"),
        _rule("unknown_record", matches.join(known, "r", "left_anti"), "r"),
        _rule("unknown_query", matches.join(queries, "s1", "left_anti"), "s1"),
        _rule("not_a_candidate", matches.join(candidates, ["s1", "r"], "left_anti"), "r"),
    ]
    done = out[0]
    for d in out[1:]:
        done = done.unionByName(d)
    return done
