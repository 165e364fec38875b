"""Where a social network comes from: a folder of delimited files, or the supplied star-schema tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import save

#: File name: schema of the columns that are used, in the order of the files. Columns further right are not read.
SCHEMAS = {
    "person": "id BIGINT, firstName STRING, lastName STRING, gender STRING, birthday DATE",
    "person_knows_person": "src BIGINT, dst BIGINT",
    "comment_hasCreator_person": "comment BIGINT, person BIGINT",
    "comment_replyOf_comment": "reply BIGINT, parent BIGINT",
    "person_hasInterest_tag": "person BIGINT, tag BIGINT",
    "tag": "id BIGINT, name STRING",
    "place": "id BIGINT, name STRING",
    "place_isPartOf_place": "child BIGINT, parent BIGINT",
    "person_isLocatedIn_place": "person BIGINT, place BIGINT",
    "organisation_isLocatedIn_place": "organisation BIGINT, place BIGINT",
    "person_studyAt_organisation": "person BIGINT, organisation BIGINT",
    "person_workAt_organisation": "person BIGINT, organisation BIGINT",
    "forum_hasTag_tag": "forum BIGINT, tag BIGINT",
    "forum_hasMember_person": "forum BIGINT, person BIGINT",
}


def symmetric(edges: DataFrame) -> DataFrame:
    """Undirected edges in both directions, once each, without loops."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    return both.where("src <> dst").distinct()


@dataclass
class Network:
    """The frames of a network; every one is lazy, so a query reads only what it needs."""

    person: DataFrame  # id, birthday
    knows: DataFrame  # src, dst: both directions
    replies: DataFrame  # src, dst: one row per reply of src to dst
    interest: DataFrame  # person, tag
    tag: DataFrame  # id, name
    place: DataFrame  # id, name
    part_of: DataFrame  # child, parent
    located: DataFrame  # person, place: home, study and work
    forum_tag: DataFrame  # forum, tag
    forum_member: DataFrame  # forum, person

    @cached_property
    def spark(self) -> SparkSession:
        return self.person.sparkSession


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(sep="|", header=True, quote="", mode="PERMISSIVE", enforceSchema=True).csv(f"{folder}/{name}.csv")


def read_folder(spark: SparkSession, folder: str) -> Network:
    """Files `<name>.csv`, `|` between values, one header line, no quotes."""

    def read(name: str) -> DataFrame:
        return _read(spark, folder, name, SCHEMAS[name])

    creator = read("comment_hasCreator_person")
    reply = read("comment_replyOf_comment")
    replies = reply.join(creator.select(F.col("comment").alias("reply"), F.col("person").alias("src")), "reply").join(creator.select(F.col("comment").alias("parent"), F.col("person").alias("dst")), "parent").select("src", "dst")
    of_organisation = read("organisation_isLocatedIn_place")
    places = read("person_isLocatedIn_place").select("person", "place")
    for name in ("person_studyAt_organisation", "person_workAt_organisation"):
        places = places.unionByName(read(name).join(of_organisation, "organisation").select("person", "place"))
    return Network(
        person=read("person").select("id", "birthday"), knows=symmetric(read("person_knows_person")), replies=replies, interest=read("person_hasInterest_tag").distinct(),
        tag=read("tag"), place=read("place"), part_of=read("place_isPartOf_place"), located=places.distinct(), forum_tag=read("forum_hasTag_tag").distinct(), forum_member=read("forum_hasMember_person").select("forum", "person").distinct(),
    )


def write_folder(net: Network, folder: str) -> str:
    """The network as files that `read_folder` reads, and the folder. A person's smallest place is the home; each other one has an organisation, for work or study in turn."""
    replies = save(net.replies.select("src", "dst", F.monotonically_increasing_id().alias("i")))
    comment = F.explode(F.array(F.struct((F.col("i") * 20).alias("comment"), F.col("dst").alias("person")), F.struct((F.col("i") * 20 + 10).alias("comment"), F.col("src").alias("person"))))
    located = save(net.located)
    home = located.groupBy("person").agg(F.min("place").alias("place"))
    away = located.join(home, ["person", "place"], "left_anti").select("person", (F.col("place") * 10).alias("organisation"), F.lit(2000).alias("since"))
    tables = {
        "person": net.person.select("id", F.lit("first").alias("firstName"), F.lit("last").alias("lastName"), F.lit("x").alias("gender"), "birthday"), "person_knows_person": net.knows, "comment_hasCreator_person": replies.select(comment.alias("c")).select("c.*"),
        "comment_replyOf_comment": replies.select((F.col("i") * 20 + 10).alias("reply"), (F.col("i") * 20).alias("parent")), "person_hasInterest_tag": net.interest, "tag": net.tag.withColumn("url", F.lit("u")), "place": net.place.withColumn("url", F.lit("u")),
        "place_isPartOf_place": net.part_of, "person_isLocatedIn_place": home, "organisation_isLocatedIn_place": net.place.select((F.col("id") * 10).alias("organisation"), F.col("id").alias("place")),
        "person_studyAt_organisation": away.where("organisation % 20 = 0"), "person_workAt_organisation": away.where("organisation % 20 <> 0"), "forum_hasTag_tag": net.forum_tag, "forum_hasMember_person": net.forum_member.withColumn("joined", F.lit("2010-01-01")),
    }
    for name, rows in tables.items():
        rows.write.options(sep="|", header=True, quote="").csv(f"{folder}/{name}.csv")
    return folder


def broken_lines(spark: SparkSession, folder: str) -> DataFrame:
    """file, lines, broken (lines of which an id, or a birthday that is not empty, cannot be read) of each file of `folder`. `read_folder` reads such values as nulls, which match nothing."""
    whole = None
    for name, schema in SCHEMAS.items():
        columns = [c.split() for c in schema.split(", ")]
        raw = _read(spark, folder, name, ", ".join(f"{c} STRING" for c, _ in columns))
        fine = [F.coalesce(F.expr(f"try_cast({c} AS {kind}) IS NOT NULL"), F.lit(False)) | ((F.col(c).isNull() | (F.col(c) == "")) if kind == "DATE" else F.lit(False)) for c, kind in columns if kind != "STRING"]
        fine = fine[0] if len(fine) == 1 else fine[0] & fine[1]
        counted = raw.agg(F.count("*").alias("lines"), F.count_if(~fine).alias("broken")).select(F.lit(name).alias("file"), "lines", "broken")
        whole = counted if whole is None else whole.unionByName(counted)
    return whole


def read_star_schema(spark: SparkSession, folder: str) -> Network:
    """A network that the supplied tables imply: customers of consecutive orders know each other, parts are forums, nations and regions are places."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    orders, line, part = read("orders"), read("lineitem"), read("part")
    topic = F.concat_ws("/", "p_brand", "p_type")
    bought = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    parts = part.select("p_partkey", topic.alias("topic"))
    names = parts.select(F.col("topic").alias("name")).distinct().select(F.xxhash64("name").alias("id"), "name")
    nation, region, supplier = read("nation"), read("region"), read("supplier")
    place_of = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("place"))
    job = ((F.col("l_linenumber") == 1) & (F.col("l_discount") < 0.005)) | ((F.col("l_linenumber") == 2) & (F.col("l_discount") > 0.095))
    employed = bought.where(job).select(F.col("o_custkey").alias("person"), "l_suppkey").distinct().join(place_of, "l_suppkey").select("person", "place")
    event = read("events").select("event_id", F.col("user_id").cast("long").alias("user"))
    later = event.select((F.col("event_id") - 1).alias("event_id"), F.col("user").alias("src"))
    following = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("src"))
    home = read("customer").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("place"))
    first_order = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").cast("date").alias("birthday"))
    return Network(
        person=read("customer").select(F.col("c_custkey").alias("id")).join(first_order, "id", "left"),
        knows=symmetric(following.join(orders.select("o_orderkey", F.col("o_custkey").alias("dst")), "o_orderkey")),
        replies=later.join(event.select("event_id", F.col("user").alias("dst")), "event_id").select("src", "dst"),
        interest=bought.where("l_returnflag = 'R'").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("person"), F.xxhash64("topic").alias("tag")).distinct(),
        tag=names,
        place=nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).union(region.select((F.col("r_regionkey") + 1000).cast("long"), "r_name")),
        part_of=nation.select(F.col("n_nationkey").cast("long").alias("child"), (F.col("n_regionkey") + 1000).cast("long").alias("parent")),
        located=home.union(employed).select("person", F.col("place").cast("long").alias("place")).distinct(),
        forum_tag=parts.select(F.col("p_partkey").alias("forum"), F.xxhash64("topic").alias("tag")),
        forum_member=bought.select(F.col("l_partkey").alias("forum"), F.col("o_custkey").alias("person")).distinct(),
    )
