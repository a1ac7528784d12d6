"""The journal's replay and the history of edits: ordered folds per target, safe to run again.

An operation sets one field of a target from `before` to `after`. A run that broke off left operations pending, some of
them already in the state. Replay takes the pending batches as wholes. On a field, the pending operations in order of op_id
are a chain: each has to begin where the one before ended, and the state's value has to be the chain's first `before` or what one of its
operations left. A batch with an operation that fits nowhere fails; its operations are taken back and the chains are
looked at again without them, until no batch fails. State and journal are one version (sources.versions), committed
together, so a replay that breaks off leaves both as they were, and one that runs again finds nothing pending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.versions import Versioned, kept

FIELD = ["target_kind", "target_id", "field"]


def misfits(state: DataFrame, live: DataFrame) -> DataFrame:
    """Batches (batch) with an operation of live that fits neither the one before it nor the state."""
    by = Window.partitionBy(*FIELD).orderBy("op_id")
    chain = live.withColumn("nth", F.row_number().over(by)).withColumn("left", F.lag("after").over(by))
    broken = chain.where((F.col("nth") > 1) & ~F.col("left").eqNullSafe(F.col("before"))).select("batch")
    # The state fits if it is the first operation's before, or any one's after: counted per field, so no chain is one row.
    rows = chain.join(state.select(*FIELD, "value"), FIELD, "left")
    fits = ((F.col("nth") == 1) & F.col("before").eqNullSafe(F.col("value"))) | F.col("after").eqNullSafe(F.col("value"))
    lost = rows.groupBy(*FIELD).agg(F.bool_or(fits).alias("fits"), F.min_by("batch", "op_id").alias("batch")).where("not fits").select("batch")
    return broken.unionByName(lost).distinct()


def replayed(state: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, journal) after the pending operations of journal (op_id, batch_id, target_kind, target_id, field, before, after, progress)
    were replayed onto state (target_kind, target_id, field, value). A batch is done, or failed and taken back; an operation
    without a batch_id is a batch of its own. A value of null is an absent field."""
    batch = F.coalesce(F.concat(F.lit("b"), "batch_id"), F.concat(F.lit("o"), F.col("op_id").cast("string")))
    pending = kept(journal.where("progress = 'pending'").withColumn("batch", batch))
    failed = pending.select("batch").where("false")
    while True:
        live = pending.join(failed, "batch", "left_anti")
        more = kept(misfits(state, live))
        if not more.limit(1).count():
            break
        failed = kept(failed.unionByName(more).distinct())
    dead = pending.join(failed, "batch", "left_semi")
    order = F.col("op_id")
    done = live.groupBy(*FIELD).agg(F.max_by(F.struct("after"), order).alias("last"))
    # What failed batches left in the state goes back to what it was before their first operation on the field.
    back = dead.join(state.select(*FIELD, "value"), FIELD, "left").groupBy(*FIELD).agg(
        F.min_by(F.struct("before"), order).alias("first"), F.bool_or(F.col("after").eqNullSafe(F.col("value")) & F.col("after").isNotNull()).alias("left"))
    rows = state.select(*FIELD, "value", F.lit(True).alias("there")).join(done, FIELD, "full").join(back, FIELD, "full")
    value = F.when(F.col("last").isNotNull(), F.col("last.after")).when(F.coalesce("left", F.lit(False)), F.col("first.before")).otherwise(F.col("value"))
    new_state = rows.select(*FIELD, value.alias("value")).where("value is not null")
    mark = F.when(F.col("progress") != "pending", F.col("progress")).when(F.col("bad"), "failed").otherwise("done")
    new_journal = journal.withColumn("batch", batch).join(failed.withColumn("bad", F.lit(True)), "batch", "left").withColumn("progress", mark).select(*journal.columns)
    return new_state, new_journal


def recover(ledger: Versioned) -> int:
    """Replay what is pending in a versioned folder with tables `state` and `journal`; the version's number."""
    state, journal = ledger.read("state"), ledger.read("journal")
    if not journal.where("progress = 'pending'").limit(1).count():
        return ledger.number()
    state, journal = replayed(state, journal)
    return ledger.write(state=state, journal=journal)


def appended(history: DataFrame, edits: DataFrame) -> DataFrame:
    """history with edits (batch_id, target_kind, target_id, field, before, after, actor) of batches that it doesn't have yet: a batch
    that comes again, whole or in part, changes nothing, and one field of a target is in a batch once, with what it became last
    (edit_id). Values are JSON strings, null stays null; an edit that changes nothing is none."""
    new = edits.join(history.select("batch_id").distinct(), "batch_id", "left_anti")
    new = new.groupBy("batch_id", "target_kind", "target_id", "field").agg(F.min_by(F.struct("before"), "edit_id").alias("a"), F.max_by(F.struct("after", "actor"), "edit_id").alias("b"))
    new = new.where(~F.col("a.before").eqNullSafe(F.col("b.after")))
    quoted = lambda c: F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))
    rows = new.select("batch_id", "target_kind", "target_id", "field", quoted(F.col("a.before")).alias("before_value"), quoted(F.col("b.after")).alias("after_value"), F.col("b.actor").alias("actor"))
    return history.select(rows.columns).unionByName(rows)


def append(ledger: Versioned, edits: DataFrame) -> int:
    """Append edits to a versioned folder's table `history`; the version's number."""
    history = ledger.read("history")
    if history is None:
        history = ledger.spark.createDataFrame([], "batch_id string, target_kind string, target_id bigint, field string, before_value string, after_value string, actor string")
    return ledger.write(history=appended(history, edits))
