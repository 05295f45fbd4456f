"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1). BENCH_CPUS: threads (default 8). Each query runs once to
warm up and is then timed, into the noop sink: ``build``, making the frame (reading schemas, compiling, analysis), and
``run``. ``queries`` holds the sum. ``by_hand`` has the same questions put directly to the DataFrame API, made and run under
the same clock, to show what the compiler adds. Training-data operators run once.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quadlight import queries as core

HEADLINE = ["revenue_by_region", "scan_bgp", "filter_range", "star_join", "fk_path_join", "optional", "optional_filter", "minus", "exists", "not_exists", "count_distinct", "sum_avg", "min_max", "group_concat", "topk", "distinct", "union3", "graph_var", "path_plus", "subselect_join", "interval_overlap", "md5_sha1_sha256", "construct", "modify"]


def by_hand(spark, d):
    """Functions that make the frames by hand; queries that have no plain counterpart (closures, updates) are left out."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    iri = lambda kind, c: F.concat(F.lit(f"http://example.org/{kind}/"), F.col(c).cast("string"))

    def revenue():
        rows = t("lineitem").where((F.col("l_shipdate") >= "2000-01-01") & (F.col("l_shipdate") < "2001-01-01")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.groupBy("r_name").agg(F.round(F.sum("l_extendedprice")).alias("v")).orderBy(F.desc("v"))

    def overlap():
        a = t("events").where("event_type = 'purchase'").select(F.col("event_id").alias("a"), F.col("ts").alias("t"), "user_id")
        b = t("events").where("event_type = 'signup'").select(F.col("event_id").alias("b"), F.col("ts").alias("s"), "user_id")
        return a.join(b, "user_id").where("s < t").select(iri("event", "a").alias("a"), iri("event", "b").alias("b"))

    def optional_filter():
        return t("documents").select("doc_id", "n_chars").join(t("labels").where("toxic = 0").withColumnRenamed("doc_id", "k"), (F.col("doc_id") == F.col("k")) & (F.col("n_chars") > 1500), "left").select(iri("doc", "doc_id").alias("d"), "quality")

    def exists():
        return t("customer").join(t("orders"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 40), "left_semi").select(iri("customer", "c_custkey").alias("c"))

    def fk_path():
        rows = t("orders").where("o_orderpriority = '1-URGENT'").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_name", "r_name")

    def construct():
        rows = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.select(iri("nation", "n_nationkey").alias("s"), F.lit("http://example.org/ns#partOf").alias("p"), F.col("r_name").alias("o")).distinct()

    return {
        "revenue_by_region": revenue,
        "scan_bgp": lambda: t("customer").select(iri("customer", "c_custkey").alias("c"), "c_name", "c_acctbal"),
        "filter_range": lambda: t("orders").where("o_totalprice > 1000 and o_totalprice <= 20000.5").select(iri("order", "o_orderkey").alias("o"), "o_totalprice"),
        "star_join": lambda: t("documents").join(t("labels").where("toxic = 0"), "doc_id").select(iri("doc", "doc_id").alias("d"), "lang", "quality"),
        "fk_path_join": fk_path,
        "optional": lambda: t("documents").join(t("labels"), "doc_id", "left").select(iri("doc", "doc_id").alias("d"), "quality"),
        "optional_filter": optional_filter,
        "minus": lambda: t("documents").join(t("labels"), "doc_id", "left_anti").select(iri("doc", "doc_id").alias("d")),
        "exists": exists,
        "not_exists": lambda: t("customer").join(t("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(iri("customer", "c_custkey").alias("c")),
        "count_distinct": lambda: t("orders").agg(F.count_distinct("o_custkey"), F.count("o_custkey")),
        "sum_avg": lambda: t("lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity"), F.round(F.avg("l_quantity") * 1000)),
        "min_max": lambda: t("customer").groupBy("c_mktsegment").agg(F.min("c_acctbal"), F.max("c_acctbal"), F.min("c_name")),
        "group_concat": lambda: t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ")),
        "topk": lambda: t("part").select("p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_name").limit(10),
        "distinct": lambda: t("part").select("p_brand", "p_size").distinct(),
        "union3": lambda: t("region").select("r_name").union(t("nation").select("n_name")).union(t("supplier").select("s_name")),
        "graph_var": lambda: t("documents").where("lang = 'fr'").groupBy(iri("source", "source")).count(),
        "subselect_join": lambda: t("customer").where("c_mktsegment = 'MACHINERY'").join(t("orders").groupBy("o_custkey").count(), F.col("c_custkey") == F.col("o_custkey")).select("c_name", "count"),
        "interval_overlap": overlap,
        "md5_sha1_sha256": lambda: t("documents").select(F.md5("text"), F.sha1("text"), F.sha2("text", 256)),
        "construct": construct,
    }


def timed(frame_of) -> tuple[float, float]:
    """Seconds to make the frame and to run it."""
    began = time.time()
    df = frame_of()
    made = time.time()
    df.write.format("noop").mode("overwrite").save()
    return round(made - began, 3), round(time.time() - made, 3)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    all_queries, llm_queries = dict(core.queries()), {}
    try:
        from quadlight.llm import queries as llm

        llm_queries = llm.queries()
    except ModuleNotFoundError as e:
        if not str(e.name).startswith("quadlight.llm"):
            raise
    plain = by_hand(spark, d)
    seconds, hand, build, run = {}, {}, {}, {}
    for n in HEADLINE:
        for kind, frame_of in (("own", lambda n=n: all_queries[n](spark, d)), ("hand", plain.get(n))):
            if frame_of is None:
                continue
            timed(frame_of)
            made, ran = timed(frame_of)
            if kind == "own":
                seconds[n], build[n], run[n] = round(made + ran, 3), made, ran
            else:
                hand[n] = {"total": round(made + ran, 3), "build": made, "run": ran}
    for n, query in llm_queries.items():
        seconds[n] = round(sum(timed(lambda query=query: query(spark, d))), 3)
    totals = {n: x["total"] for n, x in hand.items()}
    ratio = round(sum(seconds[n] for n in totals) / sum(totals.values()), 2)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "by_hand": totals, "ratio_to_by_hand": ratio, "build": build, "run": run, "by_hand_build": {n: x["build"] for n, x in hand.items()}, "by_hand_run": {n: x["run"] for n, x in hand.items()}, "sf": d.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
