"""Sales enriched with the version of their client that was valid when they were sold.

Sales and changes of clients arrive in batches, which one stateful streaming query takes in order, started anew for each
on one checkpoint. Its one stage with state is keyed by client. It adds the batch's changes, answers the waiting sales
whose time lies before the watermark H of the batch, holds the others, and then prunes: of the versions up to H only the
last of a client stays. A tick wakes each key in each batch. The last batch answers what still waits, too, after its own
sales and the pruning, as if by a batch of its own.

Clients are dealt to keys by hash, many to a key, so that a key's state is a few Arrow tables instead of many rows. State
lies in the executors' heap while its partition is at work, and in the checkpoint otherwise: a partition's state must fit a
task. A client that holds more than one in CELLS of all rows is split over ways x ways cells: its sales lie in one of `ways`
rows of cells and its versions in one of `ways` columns, so a cell has 1 / ways of either. A sale waits in each cell of its
row and gets an answer from each: the best version that was never pruned there, and the one that pruning left. Of the latter
only the last over all cells is unpruned for the client. At most CELLS clients can be split; their list is all that is
broadcast.

What goes to the driver is the largest time of each batch. Batches, checkpoint and results lie in a new folder of the
shared one for each call.

Cases: repeated changes count once, repeated sales each give a row; a null arrival counts as the last batch, days before
the first as the first; changes without valid_at are ignored; a sale without sold_at is released at once and has no
version; a null client has no versions (its changes can be late, though); null seq and change_id come first in the order of
versions, and ties in (valid_at, seq, change_id) go by op and balance; a null balance has null cents; empty batches
release what waits; empty tables give what the other one has; other columns tell changes apart and are else ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from . import common

BATCHES, FIRST_DAY, DAYS = 8, 19723, 152
LAG = 12 * 3600 * 1_000_000
#: Stands for null in columns of longs, and is smaller than every time; NO_TIME is a watermark that nothing has set.
NULL, NO_TIME = -(1 << 63), 1 - (1 << 63)
#: Clients with more than one in CELLS of all rows are split; rows of a batch for each key; least number of keys.
CELLS, KEY_ROWS, LEAST_KEYS = 192, 4096, 16
#: Rows in one Arrow table of a key's state.
CHUNK = 8192
#: Settings while the query runs: state in the heap, closed after each batch, as the next start opens its own, and kept for
#: the last batches alone. RocksDB's stores took memory beside the heap that grew with each start.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}

SALE = ["row_id", "sale_id", "client_id", "at", "ways"]
VERSION = ["client_id", "at", "seq", "change_id", "op", "cents"]
ORDER = VERSION[1:]
#: Ticks have a key and a cell, sales are given theirs by their client.
SALES = "key int, cell int, " + ", ".join(f"{c} long" for c in SALE)
STATE = "waiting array<binary>, versions array<binary>"
CHANGES = "row_id long, client_id long, at long, seq long, change_id long, op string, cents long, ways long"
ANSWER = "rec string, row_id long, id long, batch int, at long, ways long, n_open long, n_kept long, " + ", ".join(f"{k}_{c} {'string' if c == 'op' else 'long'}" for k in ("open", "kept") for c in ORDER)


def pack(table) -> list[bytes]:
    """The rows of a pandas table as Arrow streams of CHUNK rows."""
    import pyarrow as pa

    out = []
    for at in range(0, len(table), CHUNK):
        batch = pa.RecordBatch.from_pandas(table.iloc[at : at + CHUNK], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        out.append(sink.getvalue().to_pybytes())
    return out


def unpack(chunks: list[bytes], empty):
    """The rows of pack(), or an empty table like the one given."""
    import pandas as pd
    import pyarrow as pa

    return pd.concat([pa.ipc.open_stream(x).read_pandas() for x in chunks], ignore_index=True) if chunks else empty.iloc[:0]


def in_order(*parts):
    import pandas as pd

    rows = pd.concat([x for x in parts if len(x)] or [parts[0]], ignore_index=True)
    return rows.sort_values(ORDER, na_position="first", kind="stable", ignore_index=True)


def pruned(versions, to: int):
    """Of ordered versions: the last of each client up to a time, and all later ones."""
    passed = versions["at"] <= to
    return versions[passed].drop_duplicates("client_id", keep="last"), versions[~passed]


class Versions:
    """Answers sales from the versions of their clients, batch by batch; see the module's text."""

    def __init__(self, batch: int, late_before: int, pruned_to: int, h: int):
        self.batch, self.late_before, self.pruned_to, self.h = batch, late_before, pruned_to, h

    def answered(self, rows: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        columns = [x.split()[0] for x in ANSWER.split(", ")]
        sales, come = [], []
        for r in rows:
            sales.append(r.loc[r["rec"] == "sale", SALE])
            come.append(r.loc[r["rec"] == "change"])
        sales, come = pd.concat(sales, ignore_index=True), pd.concat(come, ignore_index=True)
        late = come[(come["at"] < self.late_before) & (come["copy"] == 0)]
        if len(late):
            out = late[["row_id", "at", "ways"]].assign(rec="late", id=late["change_id"], batch=self.batch)
            yield out.reindex(columns=columns).astype({"open_op": object, "kept_op": object})

        waiting, stored = state.get if state.exists else ([], [])
        if waiting:
            sales = pd.concat([unpack(waiting, sales), sales], ignore_index=True)
        kept, opened = pruned(in_order(unpack(stored, come[VERSION])), self.pruned_to)
        new = come.loc[(come["at"] >= self.late_before) & (come["client_id"] != NULL), VERSION]
        opened = in_order(opened, new)
        free = sales["at"] < self.h
        if free.any():
            yield self.answers(sales[free], opened, kept)[columns].assign(batch=self.batch)
        kept, opened = pruned(in_order(kept, opened), self.h)
        sales = sales[~free]
        if self.batch == BATCHES - 1:
            state.remove()
            if len(sales):
                yield self.answers(sales, opened, kept)[columns].assign(batch=BATCHES)
        elif len(sales) or len(kept) or len(opened):
            state.update((pack(sales), pack(in_order(kept, opened))))
        elif state.exists:
            state.remove()

    def answers(self, sales, opened, kept):
        import pandas as pd

        named = lambda versions, kind: versions.rename(columns={c: f"{kind}_{c}" for c in ORDER})
        out = sales.rename(columns={"sale_id": "id"}).assign(rec="sale").sort_values("at", kind="stable")
        out["batch"] = 0
        out["n_open"] = out["client_id"].map(opened["client_id"].value_counts()).fillna(0).astype("int64")
        out["n_kept"] = out["client_id"].isin(kept["client_id"]).astype("int64")
        whole = {f"{k}_{c}": "Int64" for k in ("open", "kept") for c in ORDER if c != "op"}
        kept = named(kept, "kept").astype({k: v for k, v in whole.items() if k.startswith("kept")})
        opened = named(opened, "open").astype({k: v for k, v in whole.items() if k.startswith("open")})
        opened["upto"] = opened["open_at"].astype("int64")
        out = pd.merge_asof(out, opened, left_on="at", right_on="upto", by="client_id")
        return out.merge(kept, on="client_id", how="left").astype({"open_op": object, "kept_op": object})


def micros(time: Column) -> Column:
    """Microseconds of a wall clock since 1970, whatever the session's zone is; NULL where there is none."""
    since = time.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce((since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long"), F.lit(NULL))


def batch_of(day: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / DAYS).cast("int"))), F.lit(BATCHES - 1))


def filled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL)).alias(column)


def split_clients(sales: DataFrame, changes: DataFrame, total: int) -> DataFrame:
    """client_id and ways of clients with more than one in CELLS rows: fewer than CELLS of them."""
    rows = sales.select(F.col("client_id").cast("long")).unionAll(changes.select(F.col("client_id").cast("long"))).filter("client_id IS NOT NULL")
    counts = rows.groupBy("client_id").agg(F.count(F.lit(1)).alias("rows"))
    ways = F.ceil(F.sqrt(F.col("rows") * CELLS / max(total, 1))).cast("long")
    return common.saved(counts.filter(F.col("rows") * CELLS > total).select("client_id", ways.alias("ways")), "split-clients")


def key_of(hashed: Column, keys: int) -> Column:
    return F.pmod(hashed, F.lit(keys)).cast("int")


def stage_batches(sales: DataFrame, changes: DataFrame, root: str, keys: int, total: int) -> None:
    """Write both tables by batch below root/staged; ticks wake each key, and each cell of a split client, in each batch."""
    split = split_clients(sales, changes, total)
    wide = lambda rows: rows.join(F.broadcast(split), "client_id", "left").withColumn("ways", F.coalesce("ways", F.lit(1).cast("long")))
    day = F.unix_date(F.col("arrived_at").cast("timestamp_ntz").cast("date"))
    rows = wide(sales.select("sale_id", F.col("client_id").cast("long"), micros(F.col("sold_at")).alias("at"), batch_of(day).alias("batch"), F.monotonically_increasing_id().alias("row_id")))
    nobody = [F.lit(None).cast("int").alias(c) for c in ("key", "cell")]
    rows = rows.select("batch", *nobody, "row_id", filled("sale_id"), filled("client_id"), "at", "ways")
    spark = sales.sparkSession
    whole = spark.range(keys, numPartitions=1).select(F.col("id").cast("int").alias("key"), F.lit(0).alias("cell"))
    cells = split.select(key_of(F.xxhash64("client_id"), keys).alias("key"), F.explode(F.sequence(F.lit(0), (F.col("ways") * F.col("ways") - 1).cast("int"))).alias("cell"))
    woken = whole.unionByName(cells).distinct().withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(BATCHES - 1))))
    ticks = woken.select("batch", "key", "cell", *[F.lit({"row_id": -1, "ways": 1}.get(c, NULL)).cast("long").alias(c) for c in SALE])
    rows.unionByName(ticks).write.partitionBy("batch").parquet(f"{root}/staged/sales")

    own = changes.filter("valid_at IS NOT NULL").distinct()
    day = F.unix_date(F.col("valid_at").cast("timestamp_ntz").cast("date")) + F.crc32(F.col("change_id").cast("string")) % 4
    cents = F.floor(100 * F.col("balance").cast("double") + 0.5).cast("long")
    rows = own.select(F.monotonically_increasing_id().alias("row_id"), F.col("client_id").cast("long"), micros(F.col("valid_at")).alias("at"), filled("seq"), filled("change_id"), "op", cents.alias("cents"), batch_of(day).alias("batch"))
    rows = wide(rows).select("batch", "row_id", filled("client_id"), "at", "seq", "change_id", "op", filled("cents"), "ways")
    rows.write.partitionBy("batch").parquet(f"{root}/staged/changes")


def watermarks(table: DataFrame) -> list[int]:
    """The watermark of each batch: the largest time of those before it, less LAG."""
    largest = {r["batch"]: r["at"] for r in table.groupBy("batch").agg(F.max("at").alias("at")).collect()}
    out, now = [], NULL
    for batch in range(BATCHES):
        out.append(now - LAG if now != NULL else NO_TIME)
        now = max(now, largest.get(batch, NULL))
    return out


def hand_over(spark: SparkSession, root: str, batch: int) -> None:
    """Move the files of a batch to where the query looks for them."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    for name in ("sales", "changes"):
        source, target = paths(f"{root}/staged/{name}/batch={batch}"), paths(f"{root}/in/{name}")
        files = source.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(target)
        if files.exists(source) and not files.rename(source, paths(target, f"b{batch}")):
            raise OSError(f"{source} could not be moved")


def feed(spark: SparkSession, root: str, batch: int, h: int, late_before: int, pruned_to: int, keys: int) -> StreamingQuery:
    """One start of the query: takes the files that have come since the last."""
    read = lambda name, schema: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/in/{name}")
    own, ways = F.pmod(F.xxhash64("row_id"), F.col("ways")), F.col("ways")
    every = F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("copy")
    key = key_of(F.when(F.col("client_id") == NULL, F.xxhash64("row_id")).otherwise(F.xxhash64("client_id")), keys)  # rows without a client are spread
    sold = read("sales", SALES).select("*", every)
    sold = sold.select(
        F.coalesce("key", key).alias("key"), F.coalesce("cell", (own * ways + F.col("copy")).cast("int")).alias("cell"), F.when(F.col("row_id") < 0, "tick").otherwise("sale").alias("rec"), *SALE, "copy",
    )
    changed = read("changes", CHANGES).select("*", every)
    changed = changed.select(key.alias("key"), (F.col("copy") * ways + own).cast("int").alias("cell"), F.lit("change").alias("rec"), "row_id", "ways", "copy", *VERSION)
    none = {c: F.lit(NULL).cast("long") for c in ("sale_id", "seq", "change_id", "cents")} | {"op": F.lit(None).cast("string")}
    both = [x.withColumns({c: v for c, v in none.items() if c not in x.columns}) for x in (sold, changed)]
    versions = Versions(batch, late_before, pruned_to, h)

    def answered(key, rows: Iterator, state: GroupState) -> Iterator:
        return versions.answered(rows, state)

    answers = both[0].unionByName(both[1]).groupBy("key", "cell").applyInPandasWithState(answered, ANSWER, STATE, "append", GroupStateTimeout.NoTimeout)
    query = answers.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def enrich(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """rec, id, batch, n_held, change_id, balance_cents and op: a row per sale and per late change."""
    spark = sales.sparkSession
    root = common.scratch(spark, "valid-time")
    n_sales, n_changes = sales.count(), changes.count()
    keys = max(LEAST_KEYS, -(-(n_sales + n_changes) // (BATCHES * KEY_ROWS)))
    stage_batches(sales, changes, root, keys, n_sales + n_changes)

    staged = lambda name, schema: spark.read.schema(f"{schema}, batch int").parquet(f"{root}/staged/{name}")
    sold, changed = watermarks(staged("sales", SALES)), watermarks(staged("changes", CHANGES))
    h = [min(pair) for pair in zip(sold, changed, strict=True)]
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        for batch in range(BATCHES):
            hand_over(spark, root, batch)
            feed(spark, root, batch, h[batch], changed[batch], h[batch - 1] if batch else NO_TIME, keys)
            for name in ("sales", "changes"):
                common.remove(spark, f"{root}/in/{name}/b{batch}")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    for name in ("staged", "in", "checkpoint"):
        common.remove(spark, f"{root}/{name}")
    return result(spark.read.schema(ANSWER).parquet(f"{root}/out"))


def result(answers: DataFrame) -> DataFrame:
    """The stage's answers, those of split clients put together, as the rows of enrich()."""
    version = lambda kind: F.when(F.col(f"{kind}_at").isNotNull(), F.struct(*[F.col(f"{kind}_{c}").alias(c) for c in ORDER])).alias(kind)
    sales = answers.filter("rec = 'sale'").select("row_id", "id", "batch", "at", "ways", "n_open", "n_kept", version("open"), version("kept"))
    split = sales.filter("ways > 1").groupBy("row_id", "id", "batch", "at")
    split = split.agg(F.sum("n_open").alias("n_open"), F.max("n_kept").alias("n_kept"), F.max("open").alias("open"), F.max("kept").alias("kept"))
    both = sales.filter("ways = 1").drop("ways").unionByName(split)
    found = F.greatest(F.col("open"), F.when(F.col("kept.at") <= F.col("at"), F.col("kept")))
    real = lambda c: F.nullif(c, F.lit(NULL))
    out = both.withColumn("found", found).select(
        F.lit("sale").alias("rec"),
        real(F.col("id")).alias("id"),
        F.col("batch").cast("long").alias("batch"),
        (F.col("n_open") + F.col("n_kept")).alias("n_held"),
        real(F.col("found.change_id")).alias("change_id"),
        real(F.col("found.cents")).alias("balance_cents"),
        F.col("found.op").alias("op"),
    )
    late = answers.filter("rec = 'late'").select("rec", real(F.col("id")).alias("id"), F.col("batch").cast("long").alias("batch"), *[F.lit(None).cast("long").alias(c) for c in ("n_held", "change_id", "balance_cents")], F.lit(None).cast("string").alias("op"))
    return out.unionByName(late)
