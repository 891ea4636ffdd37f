"""Proportional stratified interleaving of the rows of several sources into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one source that are ranked together in one task; hashed buckets are even, whatever the source's size.
ROWS_A_BUCKET = 4_000
#: Beyond so many sources, positions come from a second exchange instead of a sum over sources.
MOST_SOURCES = 2_000


def interleave(df: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", most_sources: int = MOST_SOURCES, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """df with shard (int) and shard_pos (long, from 0 over all rows).

    Within a source rows are ordered by md5(seed|id) and ranked 1..n. All rows are then ordered by the
    fractional rank (2 rank - 1) / 2n, then by source (null first), and cut into shards whose sizes differ by
    one at most. Every prefix, hence every shard, has each source's share to within about one row.

    The rank needs one exchange of the rows, on (source, hash bucket): buckets split a hot source evenly.
    Counts by bucket come from a first pass over id and source alone. With up to most_sources sources, the place of a fractional rank among the
    other sources is arithmetic on their sizes, so no global sort takes place; with more, rows are exchanged once more, by slot of the fractional
    rank, and counted there. Both ways compare fractions exactly and give the same places.

    Null ids and null sources are ordinary values (a null source is a stratum of its own). Rows that agree in
    id and source are ordered by a hash of the whole row; rows that agree in all are interchangeable. Texts
    may be empty, null or of any length. No rows give no rows. Columns of df named shard or shard_pos (in any
    case) are replaced; others pass through, whatever their names.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    names = df.columns
    source = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("-")).alias("__source")
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))).alias("__key")
    hashed = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    ids = df.select(source, key)
    total, widest = ids.groupBy("__source").count().agg(F.sum("count"), F.max("count")).first()
    total, widest = total or 0, widest or 0
    buckets = max(1, -(-widest // rows_a_bucket))
    bucket = F.shiftright(hashed * buckets, 32).cast("int").alias("__bucket")

    counts = ids.select("__source", bucket).groupBy("__source", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__source", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    sizes = counts.groupBy("__source").agg(F.sum("__n").alias("__size"))

    inside = Window.partitionBy("__source", "__bucket").orderBy("__key", "__tie", "__hash")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), source, key).withColumn("__bucket", bucket)
    rows = rows.select("*", row_key_of(id_col).alias("__tie"), F.xxhash64("__row").alias("__hash"))
    ranked = rows.withColumn("__rank", F.row_number().over(inside).cast("long"))
    ranked = ranked.join(offsets, ["__source", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before"))

    few = sizes.limit(most_sources + 1).count() <= most_sources
    if few:
        # a product of two counts must fit its type
        kind = "long" if total < 1_000_000_000 else "decimal(38,0)"
        listed = sizes.agg(F.sort_array(F.collect_list(F.struct("__source", "__size"))).alias("__sizes"))
        own = F.expr("filter(__sizes, s -> s.__source = __source)[0].__size")
        placed = ranked.crossJoin(F.broadcast(listed)).withColumn("__own", own)
        position = F.expr(
            f"aggregate(__sizes, 0L, (t, s) -> t + cast((cast(2 * __rank - 1 AS {kind}) * s.__size + __own "
            f"- if(s.__source < __source, 0, 1)) div (2 * cast(__own AS {kind})) AS long))"
        )
        placed = placed.withColumn("__pos", position)
    else:
        slots = max(1, -(-total // rows_a_bucket))
        placed = ranked.join(sizes, "__source")
        placed = placed.withColumn("__fraction", exact_fraction()).withColumn("__slot", F.expr(f"cast((2 * __rank - 1) * cast({slots} AS decimal(20,0)) div (2 * __size) AS long)"))
        starts = running_starts(placed.groupBy("__slot").agg(F.count(F.lit(1)).alias("__n")))
        ordered = Window.partitionBy("__slot").orderBy("__fraction", "__source")
        placed = placed.withColumn("__pos", F.row_number().over(ordered) - 1).join(starts, "__slot").withColumn("__pos", F.col("__pos") + F.col("__start"))
    wide = "bigint" if total * shards < 2**62 else "decimal(38,0)"
    shard = F.expr(f"cast(__pos AS {wide}) * {shards} div {max(total, 1)}").cast("int")
    # the columns of df are in __row all the way, so that no name of theirs can meet one of these
    own = [F.col("__row").getField(c).alias(c) for c in names if c.lower() not in ("shard", "shard_pos")]
    return placed.select(*own, shard.alias("shard"), F.col("__pos").cast("long").alias("shard_pos"))


def exact_fraction() -> Column:
    """The first digits of (2 rank - 1) / 2 size, as two decimals of 18 digits each.

    Two such fractions of different value differ by 1 / (4 size^2) at least, so 36 digits tell those of up to 10^17 rows apart.
    """
    step = "cast(1000000000000000000 AS decimal(19,0))"
    top, bottom = "cast(2 * __rank - 1 AS decimal(19,0))", "cast(2 * __size AS decimal(19,0))"
    high = f"(({top} * {step}) div {bottom})"
    rest = f"(cast(({top} * {step}) % {bottom} AS decimal(19,0)) * {step})"
    return F.expr(f"named_struct('high', {high}, 'low', {rest} div {bottom})")


def running_starts(counts: DataFrame, chunk: int = 4_096) -> DataFrame:
    """(__slot, __start): how many rows the slots before it have. Sums of chunks of slots come first, so no task holds all slots."""
    held = counts.withColumn("__chunk", F.expr(f"__slot div {chunk}"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row for each chunk of slots
    chunks = held.groupBy("__chunk").agg(F.sum("__n").alias("__all")).select("__chunk", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__chunk").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    within = held.select("__slot", "__chunk", F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias("__at"))
    return within.join(chunks, "__chunk").select("__slot", (F.col("__at") + F.col("__first")).alias("__start"))


def row_key_of(column: str):
    """The column inside __row as a string that tells null from empty."""
    return F.coalesce(F.concat(F.lit("="), F.col("__row").getField(column).cast("string")), F.lit("-"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write an interleaved table as one folder a shard, rows in order of shard_pos."""
    shards = df.agg(F.max("shard")).first()[0]
    df.repartitionById((shards or 0) + 1, F.col("shard")).sortWithinPartitions("shard", "shard_pos").write.partitionBy("shard").parquet(path)
