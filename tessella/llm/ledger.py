"""Has this key been seen before? An exact ledger of keys on disk."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import attach
from ..session import drop_written, new_path, settings

#: Order of rows that state none: after all others.
LAST = (1 << 63) - 1
#: Generations that a batch is joined with at most; beyond, the newest are put together.
GENERATIONS = 8
#: Bytes that a bucket of the expected history should have at most, and bytes of a key in it.
BUCKET_BYTES, KEY_BYTES = 256 << 20, 48


@dataclass(frozen=True)
class Generation:
    """A part of the ledger that is never written again: the first arrivals of some batches."""

    path: str
    table: str
    rows: int
    last_batch: int


class KeyLedger:
    """Every key that has ever arrived, with the order of its first arrival.

    The ledger is a folder of generations in shared storage. Each is a table hashed
    into buckets by key, sorted within them, one file to a bucket, so joining a batch
    shuffles and sorts the batch and neither shuffles nor sorts the history: the batch,
    in order, is merged with one generation after the other. A batch appends one
    generation. Beyond `GENERATIONS` of them the newest are merged, down to the first one that is larger
    than all newer ones together, so a key is rewritten about as often as the history has
    doubled. No keys are held in memory beyond what a sort-merge join buffers.

    Which generations count is told by the newest manifest in the folder, a file that is
    written whole and then named; what a lost job leaves behind is in none, so a batch that failed may
    be taken in again. `path` names a folder to begin or to go on with (a new one in the
    session's shared folder if it isn't given); one ledger has one writer at a time. `buckets` is
    fixed when a ledger begins: spark.sql.shuffle.partitions unless given, or more if
    `expected_keys` would make a bucket larger than BUCKET_BYTES.

    A row counts as seen if its key was in the ledger before its batch, or if a
    row of its batch with the same key has a smaller order. So rows that share
    the smallest order of a new key are all new. Rows without order come last;
    rows without key have no verdict (null). The answers are exact: the share of
    wrong ones is zero.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, path: str | None = None, expected_keys: int = 0):
        self.spark = spark
        self.path = path.rstrip("/") if path else new_path(spark, "ledger")
        self.batches, self.version, self.generations = 0, 0, []
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected_keys * KEY_BYTES // BUCKET_BYTES))
        self._open()

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest{name}")
        return at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _open(self) -> None:
        """Takes up what the newest manifest says, if there is one."""
        fs, at = self._fs()
        if not fs.exists(at()):
            return
        names = [f.getPath().getName() for f in fs.listStatus(at())]
        found = sorted(n for n in names if n.endswith(".json"))
        if not found:
            return
        stream = fs.open(at(f"/{found[-1]}"))
        try:
            state = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        self.version, self.buckets, self.batches = int(found[-1].split(".")[0]), state["buckets"], state["batches"]
        self.generations = [Generation(**(g | {"table": self._declare(g["path"])})) for g in state["generations"]]

    def _commit(self, generations: list[Generation]) -> None:
        fs, at = self._fs()
        self.version += 1
        temp, final = at(f"/{uuid.uuid4().hex}.tmp"), at(f"/{self.version:09d}.json")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "batches": self.batches, "generations": [asdict(g) for g in generations]}).encode()))
        out.close()
        if not fs.rename(temp, final):
            raise RuntimeError(f"another writer is at the ledger {self.path}")
        self.generations = generations

    def _declare(self, path: str) -> str:
        name = f"ledger_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (key BINARY, first_order BIGINT, batch INT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def _planned(self):
        """Settings under which a batch is cut into the ledger's buckets and the order of a bucket of one file is trusted."""
        return settings(self.spark, {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"})

    def _write(self, df: DataFrame) -> Generation:
        path = f"{self.path}/generation-{uuid.uuid4().hex}"
        name = self._declare(path)
        df.select("key", "first_order", "batch").write.insertInto(name)
        self.spark.catalog.refreshTable(name)
        held = self.spark.table(name).agg(F.count(F.lit(1)), F.coalesce(F.max("batch"), F.lit(0))).first()
        return Generation(path, name, held[0], held[1])

    def _unknown(self, first: DataFrame) -> DataFrame:
        """`first` (unique keys) without those that a generation holds.

        Left joins and a filter, as an anti-join would be pushed below the aggregate that made
        the keys unique, and then all rows of a frequent key would be shuffled."""
        columns = first.columns
        for g in self.generations:
            known = self.spark.table(g.table).select(F.col("key").alias("__known"))
            first = first.join(known.hint("merge"), F.col("key") == F.col("__known"), "left").filter(F.col("__known").isNull()).select(*columns)
        return first

    def _append(self, new: DataFrame) -> None:
        with self._planned():
            made = self._write(new)
            self._commit([*self.generations, made] if made.rows else self.generations)
            if not made.rows:
                self._forget([made])
            elif len(self.generations) > GENERATIONS:
                self.compact()

    def compact(self) -> None:
        """Puts the newest generations together. Buckets are merged with their like, so nothing is shuffled."""
        with self._planned():
            at, newer = len(self.generations) - 1, self.generations[-1].rows
            while at > 0 and self.generations[at - 1].rows <= 2 * newer:
                at -= 1
                newer += self.generations[at].rows
            if len(self.generations) - at < 2:
                at = max(0, len(self.generations) - 2)
            old = self.generations[at:]
            if len(old) < 2:
                return
            union = self.spark.table(old[0].table)
            for g in old[1:]:
                a, b = union.alias("a"), self.spark.table(g.table).hint("merge").alias("b")
                union = a.join(b, F.col("a.key") == F.col("b.key"), "full_outer").select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("key", "first_order", "batch")])
            self._commit([*self.generations[:at], self._write(union)])
            self._forget(old)

    def _forget(self, generations: list[Generation]) -> None:
        for g in generations:
            self.spark.sql(f"DROP TABLE IF EXISTS {g.table}")
            drop_written(self.spark, g.path)

    def table(self, since: int = 0) -> DataFrame:
        """key, first_order (null: history), batch (0: history) of the batches from `since` on."""
        out = self.spark.createDataFrame([], "key BINARY, first_order BIGINT, batch INT")
        for k, g in enumerate([g for g in self.generations if g.last_batch >= since]):
            one = self.spark.table(g.table)
            out = out.unionByName(one) if k else one
        return out.filter(F.col("batch") >= since) if since else out

    def add_history(self, keys: DataFrame) -> None:
        """Takes in the column `key` of what came before all batches."""
        with self._planned():
            new = self._unknown(keys.select("key").dropna().distinct())
            self._append(new.select("key", F.lit(None).cast("long").alias("first_order"), F.lit(0).alias("batch")))

    def take_in(self, batch: DataFrame) -> int:
        """Takes in a batch with the columns `key` and `order`, all of it later than what was taken in before, and returns its number.

        The batch is reduced to the first arrival of each key on the map side,
        so a key that holds most rows is one row of the join."""
        self.batches += 1
        with self._planned():
            self._append(self.new_keys(batch))
        return self.batches

    def new_keys(self, batch: DataFrame) -> DataFrame:
        """key, first_order, batch of the keys of a batch that the ledger doesn't hold."""
        first = batch.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(_order(F.col("order"))).alias("first_order"))
        return self._unknown(first).select("key", "first_order", F.lit(self.batches).alias("batch"))

    def verdicts(self, rows: DataFrame, since: int = 1, blank: bool = True) -> DataFrame:
        """`rows` (columns `key` and `order`, of batches that were taken in from number `since` on) with `seen`.

        A row is new only if the ledger names it as the first arrival of its
        key, so rows meet the ledger by order and key: a frequent key is spread
        over all tasks. Rows that state no order would meet by their key alone; they are
        joined by themselves, the keys that hold many of them split (`blank`: whether there
        may be such rows). Many rows that share both order and key are split at run
        time, as Spark does with a skewed side of a left join. Other columns are
        kept; a column `seen` that was there already gives way."""
        first = self.table(max(since, 1)).select("key", F.col("first_order").alias("__order"), F.lit(True).alias("__first"))
        keyed = rows.withColumn("__order", _order(F.col("order")))
        met = (keyed.filter(F.col("order").isNotNull()) if blank else keyed).join(first, ["__order", "key"], "left")
        if blank:
            late = attach(keyed.filter(F.col("order").isNull()), first.filter(F.col("__order") == LAST).drop("__order"), ["key"], "left")
            met = met.unionByName(late)
        return met.withColumn("seen", F.when(F.col("key").isNotNull(), F.col("__first").isNull())).select(*[c for c in rows.columns if c != "seen"], "seen")

    def close(self) -> None:
        """Takes the tables out of the session's catalog; the folder stays and may be opened again."""
        for g in self.generations:
            self.spark.sql(f"DROP TABLE IF EXISTS {g.table}")

    def drop(self) -> None:
        self.close()
        drop_written(self.spark, self.path)
        self.generations = []


def _order(order: Column) -> Column:
    return F.coalesce(order.cast("long"), F.lit(LAST))


def seen_before(rows: DataFrame, history: DataFrame, batches: int = 3, buckets: int | None = None) -> DataFrame:
    """`rows` (columns `key` and `order` among others) with `seen`: whether the key
    is in `history` or in a row of smaller order.

    The rows are taken in as batches of equal spans of `order`, each joined with
    the ledger of all before it. Empty inputs are fine. The ledger's files stay until
    `session.release`; its tables don't stay in the catalog."""
    ledger = KeyLedger(rows.sparkSession, buckets)
    ledger.add_history(history)
    order = F.col("order").cast("long")
    low, high, blank = rows.agg(F.min(order), F.max(order), F.count(F.lit(1)) - F.count(order)).first()
    if low is not None:
        step = max(1, -(-(high - low + 1) // batches))
        for start in range(low, high + 1, step):
            ledger.take_in(rows.filter(order.between(start, min(start + step - 1, high))))
    if blank:
        ledger.take_in(rows.filter(order.isNull()))
    out = ledger.verdicts(rows, blank=bool(blank))
    out._jdf.queryExecution().analyzed()  # the plan knows the files; their tables may leave the catalog
    ledger.close()
    return out


def wrong_answers(judged: DataFrame, history: DataFrame) -> DataFrame:
    """One row: judged, seen, wrong and error_rate of the verdicts in `judged`
    (key, order, seen), held against a check that doesn't use a ledger. A share
    of no rows is 0.

    Verdicts are counted by key and order first, so that the rows of a frequent key are
    spread, and then by key: of a key in the history all should be seen, of
    another all but those of its smallest order."""
    n, seen = F.sum("n"), F.sum("s")
    at = judged.filter(F.col("key").isNotNull()).groupBy("key", _order(F.col("order")).alias("at")).agg(F.count(F.lit(1)).alias("n"), F.count_if("seen").alias("s"))
    states = at.groupBy("key").agg(n.alias("n"), seen.alias("s"), F.min(F.struct("at", "n", "s")).alias("first"))
    known = history.select("key").dropna().distinct().withColumn("__known", F.lit(True))
    late = (F.col("n") - F.col("first.n")) - (F.col("s") - F.col("first.s"))
    wrong = F.when(F.col("__known"), F.col("n") - F.col("s")).otherwise(F.col("first.s") + late)
    total, bad = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(wrong), F.lit(0))
    return states.join(known, "key", "left").agg(total.alias("judged"), F.coalesce(F.sum("s"), F.lit(0)).alias("seen"), bad.alias("wrong"), F.coalesce(F.try_divide(bad, total), F.lit(0.0)).alias("error_rate"))
