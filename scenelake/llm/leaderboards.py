"""A feed of changes of leaderboards: items with the highest revenue of each nation, day by day, from a stream with state.

The stream keeps revenue by nation and item and is fed batch by batch. After
each batch, opening revenues are the stream's sums less the batch's own; days
inside the batch are rebuilt from them. What the batch doesn't touch comes from
the state store, and only what can reach a board: bounds from below on the
tenth place of each day leave a few items a nation and day.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exchange as X

#: Batches of the feed, days that they divide, the first of them (1 January 2024, in days since 1970), places of a board, days that a line may be late.
BATCHES, DAYS, FIRST_DAY, PLACES, LATE = 12, 180, 19723, 10, 8
_KEY = ["nation_id", "item_id"]
_LINE = "batch int, day long, arrival_day long, nation_id int, item_id long, cents double"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def dated(lines: DataFrame) -> DataFrame:
    """Lines with day (shipped, in days since 1970), arrival_day and batch.

    Days of arrival before the first belong to the first batch, those after the last to the last.
    """
    h = F.crc32(F.concat(_text("sale_id"), F.lit(","), _text("item_id"), F.lit(","), _text("vendor_id"), F.lit(","), _text("line_no")).cast("binary"))
    shipped = F.coalesce(F.unix_date(F.to_date("shipped_at")).cast("long"), F.lit(FIRST_DAY) + F.col("h") % 150)
    arrival = F.col("day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), 1 + F.floor((F.col("arrival_day") - FIRST_DAY) * BATCHES / DAYS))).cast("int")
    return lines.withColumn("h", h).withColumn("day", shipped).withColumn("arrival_day", arrival).withColumn("batch", batch).drop("h")


def cut(lines: DataFrame, items: DataFrame, vendors: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Lines with their nation and cents, written in one folder a batch; a line that no item or nation takes has no nation_id.

    Lines meet items and vendors in sorted joins, whose skewed partitions are split at run time,
    never in a broadcast; the pieces are written together, so that a batch has few files.
    Of repeated item_ids the least price counts, of repeated vendor_ids the least nation_id.
    """
    prices = items.filter("item_id is not null").groupBy("item_id").agg(F.min("price").alias("price")).withColumn("known", F.lit(True))
    nations = vendors.filter("vendor_id is not null").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id"))
    whole = lambda x: F.floor(100 * F.col(x) + 0.5).cast("double")
    own = dated(lines.select("sale_id", "line_no", "item_id", "vendor_id", "quantity", "amount", "flag", "shipped_at"))
    own = own.select("batch", "day", "arrival_day", "item_id", "vendor_id", whole("amount").alias("cents"), F.col("quantity").cast("double").alias("quantity"), F.when(F.col("flag") == "returned", -1.0).otherwise(1.0).alias("sign"))
    met = own.join(prices.hint("shuffle_merge"), "item_id", "left").join(nations.hint("shuffle_merge"), "vendor_id", "left")
    cents = F.col("sign") * F.coalesce("cents", F.col("quantity") * whole("price"), F.lit(0.0))
    nation = F.when(F.col("known"), F.col("nation_id")).alias("nation_id")
    met.select("batch", "day", "arrival_day", nation, "item_id", cents.alias("cents")).coalesce(tasks).write.partitionBy("batch").parquet(f"{folder}/lines")
    return lines.sparkSession.read.schema(_LINE).parquet(f"{folder}/lines")


def _kept(lines: DataFrame, after: int | None) -> DataFrame:
    """Lines that count: not later than allowed, with nation and item."""
    lines = lines.filter("nation_id is not null")
    return lines if after is None else lines.filter(F.col("day") + LATE >= after)


def _closing(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*_KEY).agg(F.sum("cents").alias("cents"))


def _top(*by: str, of: str, n: int) -> tuple[Column, Column]:
    """The place in descending order, ties to the smaller item, and whether it is among n: a filter by that is applied before rows move."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(of), "item_id"))
    return place, F.col("place") <= n


def _spans(lines: DataFrame, closing: DataFrame) -> DataFrame:
    """Of what a batch touches, revenue from a day (null: the batch's start) until the next change, and on the first row the least of the batch.

    Opening revenue is the closing one less the batch's sum.
    """
    own, days = Window.partitionBy(*_KEY), Window.partitionBy(*_KEY).orderBy("arrival_day")  # an item's days in a batch
    run = lines.groupBy(*_KEY, "arrival_day").agg(F.sum("cents").alias("delta"))
    run = run.select(*_KEY, "arrival_day", F.sum("delta").over(days).alias("run"), F.sum("delta").over(own).alias("all"), F.lead("arrival_day").over(days).alias("until"), F.row_number().over(days).alias("k"))
    run = run.join(closing, _KEY).withColumn("opening", F.col("cents") - F.col("all"))
    low = F.least("opening", F.min(F.col("opening") + F.col("run")).over(own))
    row = lambda since, until, cents, low: F.struct(since.alias("since"), until.alias("until"), cents.alias("cents"), low.alias("low"))
    after = row(F.col("arrival_day"), F.col("until"), F.col("opening") + F.col("run"), F.lit(None).cast("double"))
    before = row(F.lit(None).cast("long"), F.col("arrival_day"), F.col("opening"), F.col("low"))
    return run.withColumn("low", low).select(*_KEY, F.inline(F.when(F.col("k") == 1, F.array(before, after)).otherwise(F.array(after))))


def _bounds(spans: DataFrame, before: DataFrame) -> DataFrame:
    """Of each nation that the batch touches, its days in order, each with a revenue that the tenth place can't be below, and the least of these.

    Ten items keep the least revenue that they have in the batch, and ten that
    change on a day have what they then have, so either tenth is a bound.
    """
    reach = spans.filter("since is null").select(*_KEY, "low")
    moved = F.broadcast(reach.join(before.select(*_KEY), _KEY).select(*_KEY))  # no more than the board before has: ten a nation
    still = before.join(moved, _KEY, "left_anti").select(*_KEY, F.col("cents").alias("low"))
    place, top = _top("nation_id", of="low", n=PLACES)
    lows = reach.unionByName(still).withColumn("place", place).filter(top)
    least = lows.groupBy("nation_id").agg(F.coalesce(F.max(F.when((F.col("place") == PLACES) & (F.col("low") > 0), F.col("low"))), F.lit(0.0)).alias("least"))
    place, top = _top("nation_id", "since", of="cents", n=PLACES)
    days = spans.filter("since is not null").withColumn("place", place).filter(top).groupBy("nation_id", "since")
    days = days.agg(F.coalesce(F.max(F.when((F.col("place") == PLACES) & (F.col("cents") > 0), F.col("cents"))), F.lit(0.0)).alias("bound"))
    days = days.groupBy("nation_id").agg(F.sort_array(F.collect_list(F.struct(F.col("since").alias("day"), "bound"))).alias("days")).join(least, "nation_id")  # a batch's days
    days = days.select("nation_id", F.transform("days", lambda d: F.struct(d["day"].alias("day"), F.greatest(d["bound"], F.col("least")).alias("bound"))).alias("days"))
    return days.withColumn("bound", F.array_min(F.transform("days", lambda d: d["bound"])))


def _board(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    """nation_id, item_id, cents and place at the end of a batch of the stream; empty before the first."""
    schema = "nation_id int, item_id long, cents double, place int"
    return spark.read.schema(schema).parquet(f"{folder}/boards/{epoch}") if epoch >= 0 else spark.createDataFrame([], schema)


def _state(spark: SparkSession, folder: str, epoch: int) -> DataFrame:
    """nation_id, item_id and cents in the stream's state after a batch; empty before the first."""
    if epoch < 0:
        return spark.createDataFrame([], "nation_id int, item_id long, cents double")
    state = spark.read.format("statestore").option("batchId", epoch).load(f"{folder}/checkpoint")
    (name,) = state.schema["value"].dataType.names
    return state.select("key.nation_id", "key.item_id", F.col("value")[name].alias("cents"))


def _changes(folder: str, work: str, tasks: int, batch: int, epoch: int, closing: DataFrame, lines: DataFrame) -> DataFrame:
    """Changes of the boards on the days of one batch; writes the boards at its end.

    closing: revenue of what the batch touched, after it; lines: what counts in the batch; work: for tables of this step, of few files.
    """
    spark = lines.sparkSession
    before = _board(spark, folder, epoch - 1)
    spans = X.saved(_spans(lines, closing).coalesce(tasks), work, "spans")
    bounds = X.saved(_bounds(spans, before).coalesce(tasks), work, "bounds")

    openings = spans.filter("since is null").drop("low").unionByName(_state(spark, folder, epoch - 1).withColumns({"since": F.lit(None).cast("long"), "until": F.lit(None).cast("long")}))
    openings = openings.join(bounds.select("nation_id", "bound"), "nation_id").filter("cents > 0 and cents >= bound")
    # what the batch touches is in both, with equal revenue, and ends with its first change
    openings = openings.groupBy(*_KEY).agg(F.max("cents").alias("cents"), F.max("until").alias("until")).withColumn("since", F.lit(None).cast("long"))
    held = spans.filter("since is not null and cents > 0").drop("low").unionByName(openings)
    lasts = lambda d: (d["bound"] <= F.col("cents")) & (F.col("since").isNull() | (d["day"] >= F.col("since"))) & (F.col("until").isNull() | (d["day"] < F.col("until")))
    each = F.transform("days", lambda d, k: F.struct(d["day"].alias("day"), d["bound"].alias("bound"), k.alias("k")))
    grid = held.join(bounds.select("nation_id", F.size("days").alias("n"), each.alias("days")), "nation_id").select(*_KEY, "cents", "n", F.inline(F.filter("days", lasts)))
    place, top = _top("nation_id", "k", of="cents", n=PLACES)
    board = X.saved(grid.withColumn("place", place).filter(top).select(*_KEY, "cents", "n", "k", "place").coalesce(tasks), work, "board")

    last = board.filter("k = n - 1").select(*_KEY, "cents", "place")
    last.unionByName(before.join(bounds, "nation_id", "left_anti")).coalesce(tasks).write.mode("overwrite").parquet(f"{folder}/boards/{epoch}")
    none = lambda kind: F.lit(None).cast(kind)
    new = board.select(*_KEY, "k", F.col("place").alias("new_rank"), none("int").alias("old_rank"), F.col("cents").alias("now"), none("double").alias("was"))
    old = board.filter("k < n - 1").select(*_KEY, (F.col("k") + 1).alias("k"), "place", "cents").unionByName(before.join(bounds.select("nation_id"), "nation_id").select(*_KEY, F.lit(0).alias("k"), "place", "cents"))
    old = old.toDF(*_KEY, "k", "old_rank", "was").withColumns({"new_rank": none("int"), "now": none("double")})
    diff = new.unionByName(old).groupBy(*_KEY, "k").agg(*(F.max(c).alias(c) for c in ("new_rank", "old_rank", "now", "was"))).filter("not (new_rank <=> old_rank)")
    diff = X.saved(diff.join(bounds, "nation_id").select(*_KEY, F.col("days")[F.col("k")]["day"].alias("arrival_day"), "new_rank", "old_rank", "now", "was").coalesce(tasks), work, "diff")
    # what leaves a board has changed, or is as it was when others pass it
    left = diff.filter("now is null").join(spans.filter("since is not null").drop("low"), _KEY).filter("arrival_day >= since and (until is null or arrival_day < until)")
    diff = diff.join(left.select(*_KEY, "arrival_day", F.col("cents").alias("then")), [*_KEY, "arrival_day"], "left")
    kind = F.when(F.col("old_rank").isNull(), "enter").when(F.col("new_rank").isNull(), "exit").otherwise("move")
    return diff.select("nation_id", "arrival_day", "item_id", F.lit(batch).alias("batch"), kind.alias("change"), "old_rank", "new_rank", F.coalesce("now", "then", "was").cast("long").alias("revenue"))


def feed(lines: DataFrame, items: DataFrame, vendors: DataFrame) -> DataFrame:
    """Changes of each nation's ten highest revenues after each day of arrival, from lines fed in batches to a stream.

    One row for each item whose place differs from the previous board: nation_id,
    arrival_day, item_id, batch, change (enter, exit, move), old_rank, new_rank
    (null: off the board) and revenue in cents after the day.

    A line of null shipped_at gets a day by its hash; null amounts are quantity
    times price, or 0; lines of unknown or null item, vendor or nation are
    ignored but count for what is late. Repeated lines add up. Ties of revenue
    go to the smaller item_id. Batches without lines are left out; empty tables
    give no rows. Other columns are not read. Sums are of whole cents in
    doubles, so exact below 2^53.

    Every call has its own folder and stream. Per batch, state is read once and
    cut by a bound of its nation; what is left, a few items a nation, is put in
    order. A day's board is never collected. State has a row for each nation and
    item in the session's store (spark.sql.streaming.stateStore.providerClass):
    where that doesn't fit the executors' heap, name RocksDB's provider there.
    """
    spark = lines.sparkSession
    folder = X.workdir(spark)
    tasks = X.deal(spark, X.input_bytes(lines.withColumn("text", F.lit("-" * 64))), 128 << 20)  # of a line, where files don't say it
    written = cut(lines, items, vendors, folder, tasks)
    latest = dict(written.groupBy("batch").agg(F.max("day")).collect())  # a row a batch
    schema = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"
    after, done = None, []
    for batch in sorted(latest):
        path, limit = f"{folder}/feed/batch={batch}", after
        _moved(spark, f"{folder}/lines/batch={batch}", path)

        def step(sums: DataFrame, epoch: int, batch: int = batch, path: str = path, limit: int | None = limit) -> None:
            work = f"{folder}/steps/{epoch}-{uuid.uuid4().hex}"
            own = _kept(spark.read.schema(_LINE.partition(", ")[2]).parquet(path), limit)
            closing = spark.read.schema(sums.schema).parquet(_put(sums.coalesce(tasks), f"{work}/closing"))
            _changes(folder, work, tasks, batch, epoch, closing, own).coalesce(tasks).write.mode("overwrite").parquet(f"{folder}/changes/{epoch}")
            X.dropped(spark, work)
            done.append(epoch)

        stream = _kept(spark.readStream.schema(_LINE).parquet(f"{folder}/feed"), limit)
        query = _closing(stream).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(step).start()
        query.awaitTermination()
        after = max(x for x in (after, latest[batch]) if x is not None)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{folder}/changes/{epoch}" for epoch in sorted(set(done))))


def _moved(spark: SparkSession, old: str, new: str) -> None:
    """Hands a written folder to the stream, which then sees all of its files at once."""
    a, b = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    files = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(b.getParent())
    if not files.rename(a, b):
        raise OSError(f"{old} could not be moved to {new}")


def _put(rows: DataFrame, path: str) -> str:
    rows.write.parquet(path)
    return path
