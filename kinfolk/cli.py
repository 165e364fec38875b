"""Run queries from a file or the command line.

    python -m kinfolk.cli DATA FILE QUERIES [N]      each line queryN(...); with N, those of one kind only
    python -m kinfolk.cli DATA PARAM N ARG...        one query

Prints one answer a line, in input order, and a line `label,load_us,query_us` on standard error.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .plans import social
from .session import ship_package
from .sources.network import Network, read_folder


def answers(net: Network, asked: DataFrame) -> list[str]:
    """The answers to parsed queries (query_no, kind, ...), in order of query_no. All path queries share their loops, and so do all interest queries."""
    rows = asked.orderBy("query_no").collect()
    out: dict[int, str] = {}
    paths = [(r.query_no, r.p1, r.p2, r.x) for r in rows if r.kind == 1]
    if paths:
        frame = net.spark.createDataFrame(paths, "query_no long, p1 long, p2 long, x int")
        out |= {r.query_no: str(r.distance) for r in social.shortest_paths(net, frame).collect()}
    ranges = [(r.query_no, r.k, str(r.d)) for r in rows if r.kind == 2]
    if ranges:
        top = social.top_interests_of(net, net.spark.createDataFrame(ranges, "query_no long, k int, since string"))
        out |= {n: "" for n, *_ in ranges} | {r.query_no: r.answer for r in text.joined_by(top, "query_no", F.col("name"), -F.col("size"), F.col("name")).collect()}
    for r in rows:
        if r.kind == 3:
            top = text.joined(social.similar_pairs(net, r.k, r.h, r["name"]), F.concat_ws("|", "a", "b"), -F.col("common"), F.col("a"), F.col("b"))
        elif r.kind == 4:
            top = text.joined(social.top_central(net, r.k, r["name"]), F.col("person").cast("string"), -F.col("centrality"), F.col("person"))
        else:
            continue
        out[r.query_no] = top.first().answer
    return [out[r.query_no] for r in rows]


def main(args: list[str]) -> None:
    data, mode, *rest = args
    began = time.time()
    spark = SparkSession.builder.appName("kinfolk").getOrCreate()
    ship_package(spark)
    if mode == "FILE":
        with open(rest[0]) as f:
            lines = list(enumerate(f.read().splitlines()))
    else:
        lines = [(0, f"query{rest[0]}({', '.join(rest[1:])})")]
    asked = text.parsed(spark.createDataFrame(lines, "query_no long, value string"))
    if mode == "FILE" and len(rest) > 1:
        asked = asked.where(F.col("kind") == int(rest[1]))
    net = read_folder(spark, data)
    loaded = time.time()
    for line in answers(net, asked):
        print(line)
    print(f"{mode},{int((loaded - began) * 1e6)},{int((time.time() - loaded) * 1e6)}", file=sys.stderr)


if __name__ == "__main__":
    main(sys.argv[1:])
