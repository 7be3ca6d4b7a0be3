"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

Each document is repeated Poisson(rate) times, where the rate is the repetition that turns its source's share into
the target weight. The count inverts the Poisson distribution at a uniform number from a hash of seed and id, so it
is the same on every run and for any partitioning; copies are then shuffled globally by another hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources up to this number are broadcast with their distributions; more are joined by key.
BROADCAST_SOURCES = 10_000
#: A larger rate is drawn as the sum of equal parts up to this, as a sum of independent Poisson counts is one.
PART_RATE = 200.0
#: Copies made at a time, so that no array grows with the rate.
COPIES = 4096


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 digest of the parts, joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_steps(rate: Column) -> Column:
    """The distribution function of Poisson(rate) at 0, 1, 2, ..., as far as it can matter to a 52-bit number."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))
    step = lambda a, k: F.struct((a["term"] * rate / k).alias("term"), (a["sum"] + a["term"] * rate / k).alias("sum"), F.concat(a["steps"], F.array(a["sum"] + a["term"] * rate / k)).alias("steps"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step)["steps"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text", epochs: float = 1.0) -> DataFrame:
    """(source, rate): mean repetitions, so that each source makes its weight of epochs times the input's UTF-8 bytes.

    Without weights every source that has text weighs the same. Sources that weights does not name have rate 0, a
    null source is a source of its own (named by None). A rate may be of any size: a source of few bytes is repeated
    until it makes its weight.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")).alias("bytes"))
    all_ = sizes.agg(F.sum("bytes").alias("total"), F.sum((F.col("bytes") > 0).cast("long")).alias("n"))
    x = sizes.crossJoin(F.broadcast(all_))  # one row
    if weights is None:
        weight = F.lit(1.0) / F.col("n")
    else:
        scale = float(sum(weights.values()))
        weight = F.lit(0.0)
        for k, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(w / scale)).otherwise(weight)
    rate = F.when(F.col("bytes") > 0, weight * F.lit(float(epochs)) * F.col("total") / F.col("bytes")).otherwise(F.lit(0.0))
    return x.select("source", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """docs with every row repeated by its Poisson count, in globally shuffled order.

    Two columns are added: copy (0, 1, ...) and shuffle_key, a hash of seed, id and copy by which the rows are range
    partitioned and sorted. Repeated rows are drawn alike and each stays with its own copies; rows with a null id
    share one draw per source and text. Empty texts are repeated at their source's rate; a source without any text
    goes. Columns of docs named copy or shuffle_key are replaced. An empty table gives an empty result.
    """
    rates = source_rates(docs, weights, source_col, text_col, epochs).withColumn("_mr_parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int")))
    rates = rates.withColumn("_mr_steps", poisson_steps(F.col("rate") / F.col("_mr_parts"))).select(F.col("source").alias("_mr_source"), "_mr_parts", "_mr_steps")
    few = rates.select("_mr_source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    keep = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    x = docs.select(*keep)
    who = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    x = x.join(F.broadcast(rates) if few else rates, F.col(source_col).cast("string").eqNullSafe(F.col("_mr_source")))
    x = x.withColumn("_mr_u", uniform(F.lit(f"{seed}"), F.lit("count"), who))
    x = x.withColumn("_mr_n", F.size(F.filter("_mr_steps", lambda s: F.col("_mr_u") >= s)))
    part = lambda k: uniform(F.lit(f"{seed}"), F.concat(F.lit("count "), k.cast("string")), who)
    rest = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_mr_parts") - 1), part), F.lit(0), lambda n, u: n + F.size(F.filter("_mr_steps", lambda s: u >= s)))
    x = x.withColumn("_mr_n", F.when(F.col("_mr_parts") > 1, F.col("_mr_n") + rest).otherwise(F.col("_mr_n")))
    x = x.where("_mr_n > 0").withColumn("_mr_at", F.explode(F.sequence(F.lit(0), F.col("_mr_n") - 1, F.lit(COPIES))))
    x = x.withColumn("copy", F.explode(F.sequence(F.col("_mr_at"), F.least(F.col("_mr_at") + (COPIES - 1), F.col("_mr_n") - 1))))
    x = x.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.lit("order"), who, F.col("copy").cast("string")).cast("binary")))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return x.select(*keep, "copy", "shuffle_key").repartitionByRange(n, "shuffle_key").sortWithinPartitions("shuffle_key")
