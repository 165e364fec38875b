"""Mixing sources to target weights with a time-varying curriculum; DataFrame functions only.

Each source gets a target number of words: its weight's share of the whole mix, at most `most_repeats` times its own words, what
is above being shared out again by weight. Its weight over training time t in [0, 1] is linear, from 2/(1+c) to 2c/(1+c) of its mean for a
curriculum slope c. A source's documents stand in an order of hashes, repeated as often as the target needs; the words before a copy are its
cumulative demand, and inverting the integral of the weight at that demand gives the copy's training position. Copies are range-sorted by it.

Ranks within a source come from sums over hash buckets, so that a source with most of the documents is spread over many tasks.

Cases: a null text has size 0 and is taken 0 words; null sources are one source, last in order; rows with equal ids and texts stand next to each
other and are taken alike or differ by one repeat; rows with null or repeated ids are placed and copied each by its own; a source without words has
target 0; no rows give no rows; other columns only settle the order of rows with equal ids and texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Rows aimed at in a (source, bucket) group.
BUCKET_ROWS = 1000
#: What copies are range-sorted by.
TRAINING_ORDER = ("train_position", "doc_id", "tie", "copy")


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`: word starts are counted by the lengths left when all but them is taken away."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most_repeats: float) -> DataFrame:
    """source, source_size, weight, target of each source: water-filling, one pass over the sources a round."""
    by_code_point = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(by_code_point) - 1) % len(weights)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = save(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    capped = F.lit(False)
    level = 0.0
    cap = F.col("source_size") * F.lit(float(most_repeats))
    while True:
        held = sources.agg(F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.sum(capped.cast("int"))).first()
        if not held[1]:
            break
        level = max(0.0, total - held[0]) / held[1]
        capped = F.col("weight") * F.lit(level) >= cap
        if sources.agg(F.sum(capped.cast("int"))).first()[0] == held[2]:
            break
    return sources.withColumn("target", F.when(capped, cap).otherwise(F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most_repeats: float = 2.0, slopes: tuple[float, ...] = (3.0, 1.0, 1 / 3)) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, repeats, position (of its first copy, null if not taken), slope, before.

    `weights` and `slopes` are dealt to the sources in code point order, repeating.
    """
    return _placed(docs, False, weights, share, most_repeats, slopes).select("doc_id", "source", "size", "source_size", "target", "taken", "repeats", "position", "slope", "before")


def _placed(docs: DataFrame, whole: bool, weights: tuple[float, ...], share: float, most_repeats: float, slopes: tuple[float, ...]) -> DataFrame:
    """The rows of `mix` and `tie`, a hash of the row; with its whole row as column doc if `whole`."""
    hashable = [F.col(c) for c, t in docs.dtypes if "map<" not in t]
    carried = [F.struct(*docs.columns).alias("doc")] if whole else []
    # all from the row itself: it can be read again with its text, and no row has to find its place by an id
    rows_of = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(29), F.col("doc_id")).alias("h"), F.xxhash64(*hashable).alias("tie"), *carried)
    sized = save(rows_of.drop("doc"))
    source_targets = targets(sized, weights, share, most_repeats)
    by_code_point = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    slope = F.element_at(F.array(*map(F.lit, slopes)), ((F.row_number().over(by_code_point) - 1) % len(slopes) + 1).cast("int"))
    source_targets = save(source_targets.withColumn("slope", slope.cast("double")))

    rows = sized.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    bucket = F.pmod(F.shiftright("h", 20), F.lit(buckets)).cast("int")
    sums = sized.withColumn("bucket", bucket).groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    starts = save(starts.join(source_targets, starts.source.eqNullSafe(source_targets.source)).select(starts.source, "bucket", "start", "source_size", "target", "slope"))
    own = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows_of.where("size > 0") if whole else sized  # rows without words do not move the others
    placed = dealt.withColumn("bucket", bucket).withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    key = [placed.source.eqNullSafe(starts.source), placed.bucket == starts.bucket]
    placed = placed.join(starts, key).select(placed.doc_id, placed.source, "size", "tie", *(["doc"] if whole else []), "source_size", "target", "slope", (F.col("start") + F.col("own")).alias("before"))

    # whole rounds through the source, then once more for the documents whose middle lies in what is left
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.col("target") - rounds * F.col("source_size")
    repeats = rounds + ((F.col("before") + F.col("size") / 2) <= left).cast("long")
    repeats = F.when(F.col("size") > 0, F.least(repeats, F.lit(int(most_repeats)))).otherwise(0)
    return (
        placed.withColumn("repeats", repeats.cast("long"))
        .withColumn("taken", F.col("repeats") * F.col("size"))
        .withColumn("position", F.when(F.col("repeats") > 0, position(F.col("before"), F.col("target"), F.col("slope"))))
    )


def position(demand: Column, target: Column, slope: Column) -> Column:
    """When, in [0, 1], a source has delivered the share demand / target: the inverse of the integral of its linear weight."""
    done = F.least(F.greatest(demand / target, F.lit(0.0)), F.lit(1.0))
    first, rise = 2 / (1 + slope), 2 * (slope - 1) / (1 + slope)
    return F.when(F.abs(rise) < 1e-12, done).otherwise(F.abs((F.sqrt(first * first + 2 * rise * done) - first) / rise))


def curriculum(
    docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most_repeats: float = 2.0, slopes: tuple[float, ...] = (3.0, 1.0, 1 / 3)
) -> DataFrame:
    """The documents as often as the mix takes them, in the order of their training positions, with column `train_position` added."""
    placed = _copies(_placed(docs, True, weights, share, most_repeats, slopes), "doc")
    return placed.orderBy(*TRAINING_ORDER).select("doc.*", "train_position")


def schedule(
    docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most_repeats: float = 2.0, slopes: tuple[float, ...] = (3.0, 1.0, 1 / 3)
) -> DataFrame:
    """The rows of `mix`, with the training positions of all copies of a row (positions) and their numbers from 0 in the training order of all copies (places); no copies: empty.

    The copies are range-sorted as those of `curriculum`; a copy's place is its number in its range behind the copies of the ranges before.
    """
    rows = save(_placed(docs, False, weights, share, most_repeats, slopes))
    kept = ["doc_id", "source", "size", "source_size", "target", "taken", "repeats", "position", "slope", "before"]
    in_turn = save(_copies(rows, *kept[1:]).orderBy(*TRAINING_ORDER).withColumn("at", F.monotonically_increasing_id()))
    ranges = in_turn.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("copies"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the sort
    starts = ranges.select("range", F.coalesce(F.sum("copies").over(earlier), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    numbered = in_turn.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("range")).withColumn("place", place)
    # before differs between rows of one source that have words, so a group is one row's copies
    taken = numbered.groupBy(*kept).agg(F.sort_array(F.collect_list(F.struct("copy", "train_position", "place"))).alias("of"))
    taken = taken.select(*kept, F.col("of.train_position").alias("positions"), F.col("of.place").alias("places"))
    rest = rows.where("repeats = 0").select(*kept, F.array().cast("array<double>").alias("positions"), F.array().cast("array<long>").alias("places"))
    return taken.unionByName(rest)


def _copies(placed: DataFrame, *kept: str) -> DataFrame:
    """The copies of rows of `_placed`, each with its train_position, doc_id, tie, copy (from 0) and the columns `kept`."""
    copies = placed.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    demand = F.col("before") + F.col("copy") * F.col("source_size")
    return copies.select(*kept, "doc_id", "tie", "copy", position(demand, F.col("target"), F.col("slope")).alias("train_position"))


def in_order(docs: DataFrame, name: str) -> DataFrame:
    """`docs`, read from files that were written in order, with a column `name` from 0 to 1 that rises with it: the file's place among the files, then the row's in its file."""
    at = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    files = save(at.groupBy("_file").agg(F.count("*").alias("_rows")))  # one row a file
    names = files.select("_file", "_rows", F.regexp_extract("_file", r"part-(\d+)", 1).cast("long").alias("_part"))
    before = Window.orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = names.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    total = files.agg(F.sum("_rows")).first()[0] or 1
    placed = at.join(F.broadcast(starts), "_file")
    return placed.withColumn(name, (F.col("_start") + F.col("_index") + 0.5) / F.lit(float(total))).select(*docs.columns, name)
