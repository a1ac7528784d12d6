"""Progress, journal, stages, limits, retention and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.versions import kept


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last writer of each key, in a total order."""
    by = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")


def limited(events: DataFrame, key: str, at: str, most: int, seconds: int) -> DataFrame:
    """events with `recent`, those of the key in the window up to it, and whether it is over the limit. Equal times
    count together."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("limited", F.col("recent") > most)


def ready(stages: DataFrame, edges: DataFrame, progress: DataFrame) -> DataFrame:
    """(book_id, stage) that may start: all required stages succeeded or skipped, itself not started or failed."""
    mark = lambda *status: F.collect_set(F.when(F.col("book_id").isNotNull() & F.col("status").isin(*status), F.col("stage")))
    # A book is one row with at most each of the few stages in its lists; it is dealt once.
    books = progress.groupBy("book_id").agg(mark("succeeded", "skipped").alias("ok"), mark("succeeded", "skipped", "running").alias("busy"))
    wanted = stages.select("stage").join(edges, "stage", "left").groupBy("stage").agg(F.collect_set("requires").alias("requires"))
    able = ~F.coalesce(F.array_contains("busy", F.col("stage")), F.lit(False)) & (F.size(F.array_except("requires", "ok")) == 0)
    return books.join(F.broadcast(wanted)).where(able).select("book_id", "stage")


def backoff(failures: Column, base: Column, cap: int = 86_400) -> Column:
    """Seconds to the next run: from 3 failures on the base doubles with each, up to the cap."""
    power = F.pow(F.lit(2.0), F.least(F.greatest(failures - 2, F.lit(0)), F.lit(20)))
    return F.when(failures < 3, base).otherwise(F.least(base * power, F.lit(cap))).cast("long")


def upserted(old: DataFrame, new: DataFrame, key: list[str], ignore: bool = False) -> DataFrame:
    """old with new: rows of a key in both are the new ones, or with `ignore` the old ones."""
    if ignore:
        return old.unionByName(new.join(old, key, "left_anti"))
    return new.unionByName(old.join(new, key, "left_anti"))


def check(name: str, bad: DataFrame, fails: bool = True) -> DataFrame:
    """(check_name, status, n) of the rows that a check objects to."""
    return bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("check_name"), F.when(F.col("n") == 0, "ok").otherwise("fail" if fails else "warn").alias("status"), "n")


def json_diff(pre: Column, post: Column) -> Column:
    """(key, kind, before, after) of the top fields in which two JSON objects differ, by key; null is absent."""
    a, b = (F.from_json(x, "map<string,string>") for x in (pre, post))
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    rows = F.transform(keys, lambda k: F.struct(k.alias("key"), F.try_element_at(a, k).alias("before"), F.try_element_at(b, k).alias("after")))
    kind = lambda r: F.when(r["before"].isNull(), "added").when(r["after"].isNull(), "removed").otherwise("changed")
    return F.transform(F.filter(rows, lambda r: ~r["before"].eqNullSafe(r["after"])), lambda r: F.struct(r["key"].alias("key"), kind(r).alias("kind"), r["before"].alias("before"), r["after"].alias("after")))


def synced(progress: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """progress (book_id, position_ms, is_finished, synced_at) after requests (book_id, request_id, position_ms, is_finished): the last
    request of a book replaces its row, at now, unless that row was synced after now (a clock that runs ahead)."""
    new = latest(requests, ["book_id"], [F.desc("request_id")]).select("book_id", F.col("position_ms").alias("p"), F.col("is_finished").alias("f"), F.lit(True).alias("asked"))
    rows = progress.join(new, "book_id", "full")
    take = F.col("asked").isNotNull() & (F.col("synced_at").isNull() | (F.col("synced_at") <= now))
    return rows.select("book_id", F.when(take, F.col("p")).otherwise(F.col("position_ms")).alias("position_ms"), F.when(take, F.col("f")).otherwise(F.col("is_finished")).alias("is_finished"), F.when(take, now).otherwise(F.col("synced_at")).alias("synced_at"))


def status_effects(books: DataFrame, progress: DataFrame) -> DataFrame:
    """progress (book_id, is_finished) after books got their reading_status: finished ones are finished, with a row of their own if they
    had none; reading ones are not; other statuses change nothing."""
    status = books.select("book_id", "reading_status")
    rows = progress.join(status, "book_id", "left").select("book_id", F.when(F.col("reading_status") == "finished", True).when(F.col("reading_status") == "reading", False).otherwise(F.col("is_finished")).alias("is_finished"))
    return rows.unionByName(status.where("reading_status = 'finished'").join(progress, "book_id", "left_anti").select("book_id", F.lit(True).alias("is_finished")))


def retry_after(events: DataFrame, key: str, at: str, most: int, seconds: int) -> DataFrame:
    """events as limited() gives them with retry_after: where over the limit, the seconds (1 at least) until the oldest event in the
    window leaves it."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    oldest = F.unix_micros(F.min(F.col(at).cast("timestamp")).over(w))
    wait = F.greatest(F.lit(1), F.ceil((oldest + seconds * 1_000_000 - F.unix_micros(F.col(at).cast("timestamp"))) / 1_000_000))
    return limited(events.withColumn("retry_after", wait), key, at, most, seconds).withColumn("retry_after", F.when(F.col("limited"), F.col("retry_after").cast("long")))


def stage_states(events: DataFrame) -> DataFrame:
    """(book_id, stage, status, started_at, tries) of stage events (book_id, stage, status, at, event_id): the last one's status, the last
    start, and how often it was started."""
    order = F.struct("at", "event_id")
    return events.groupBy("book_id", "stage").agg(
        F.max_by("status", order).alias("status"), F.max(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"), F.count_if(F.col("status") == "running").alias("tries"))


def pending_batches(journal: DataFrame) -> DataFrame:
    """(batch_id, op_ids) of pending operations (op_id, batch_id, progress), in order of op_id; those without a batch are one."""
    return journal.where("progress = 'pending'").groupBy("batch_id").agg(F.array_sort(F.collect_list("op_id")).alias("op_ids"))


def journal_list(journal: DataFrame, *, kind: str | None = None, target: str | None = None, target_id: int | None = None, batch: str | None = None, progress: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of a journal, newest first; an absent condition is none. 50 rows unless asked, 200 at most."""
    rows = journal
    for column, value in (("op_kind", kind), ("target_kind", target), ("target_id", target_id), ("batch_id", batch), ("progress", progress)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("op_id")).offset(max(0, offset)).limit(page_rows(limit))


def page_rows(asked: int | None, default: int = 50, most: int = 200) -> int:
    """Rows of a page: the default unless asked, 1 at least, `most` at most."""
    return default if asked is None else min(most, max(1, asked))


def nested_diff(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, path, kind, before, after) where two JSON texts differ, by dotted path: objects are compared field by field, to any depth,
    other values whole; null, and a text that isn't JSON, is absent. A round a level, until no objects are left; what goes deeper is
    written as JSON, so a level starts from the one before and not from the texts."""
    both = rows.select(key, F.lit("").alias("path"), F.expr(f"try_parse_json({before})").alias("a"), F.expr(f"try_parse_json({after})").alias("b"))
    found = None
    while True:
        is_object = lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))
        none = lambda c: F.when(~F.is_variant_null(c), F.to_json(c))
        deeper = is_object("a") & is_object("b")
        flat = both.where(~deeper).select(key, "path", none(F.col("a")).alias("before"), none(F.col("b")).alias("after")).where("NOT (before <=> after)")
        found = flat if found is None else found.unionByName(flat)
        inner = kept(both.where(deeper).select(key, "path", F.to_json("a").alias("a"), F.to_json("b").alias("b")), "deeper")
        if not inner.limit(1).count():
            break
        x, y = (F.parse_json(c).cast("map<string,variant>") for c in "ab")
        inner = inner.select(key, "path", x.alias("x"), y.alias("y")).select(key, "path", "x", "y", F.explode(F.array_distinct(F.concat(F.map_keys("x"), F.map_keys("y")))).alias("k"))
        name = F.when(F.col("path") == "", F.col("k")).otherwise(F.concat("path", F.lit("."), "k"))
        both = inner.select(key, name.alias("path"), F.try_element_at("x", F.col("k")).alias("a"), F.try_element_at("y", F.col("k")).alias("b"))
    return found.select(key, "path", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed").alias("kind"), "before", "after")


def fresh(wanted: DataFrame, cache: DataFrame, version: str, locale: str | None = None) -> DataFrame:
    """wanted (book_id) with `fresh`: whether the cache (book_id, version, locale) has a row of this version (and locale, if one is given)."""
    own = cache.where(F.col("version") == version)
    if locale is not None:
        own = own.where(F.col("locale").eqNullSafe(F.lit(locale)))
    return wanted.join(own.select("book_id", F.lit(True).alias("hit")).distinct(), "book_id", "left").select("book_id", F.col("hit").isNotNull().alias("fresh"))


def reset(progress: DataFrame, caches: DataFrame, provenance: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of progress (book_id, stage), caches (book_id, stage) and provenance (book_id, stage) once the stages asked for
    (book_id, stage) are reset."""
    return tuple(rows.join(asked.select("book_id", "stage").distinct(), ["book_id", "stage"], "left_anti") for rows in (progress, caches, provenance))


def stale(rows: DataFrame, at: str, now: Column, days: int = 90) -> DataFrame:
    """Rows older than so many days: what a cleanup would take."""
    return rows.where(F.col(at) < now - F.make_dt_interval(F.lit(days)))


def deleted(books: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """books with those of gone (book_id) soft-deleted: one that is so already keeps its time."""
    return books.join(gone.select("book_id", F.lit(True).alias("goes")).distinct(), "book_id", "left").withColumn("deleted_at", F.when(F.col("goes").isNotNull(), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))).drop("goes")


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) of fields that a patch changes; in the patch null is no change and blank is null."""
    pairs = old.select(key, *[F.col(f).cast("string").alias(f"old_{f}") for f in fields]).join(new.select(key, *[F.col(f).cast("string").alias(f"new_{f}") for f in fields]), key)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("before"), F.nullif(F.trim(f"new_{f}"), F.lit("")).alias("after"), F.col(f"new_{f}").isNotNull().alias("asked")) for f in fields]))
    return pairs.select(key, cells.alias("c")).select(key, "c.*").where("asked AND NOT (before <=> after)").drop("asked")


def longest_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path_id, path) with the deepest of roots (root) that holds each: a path's ancestors, and itself, are rows that meet
    roots on an equal key."""
    parts = F.split("path", "/")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = paths.select("path_id", F.explode(each).alias("root")).where("root <> ''")
    held = rows.join(roots.select("root").distinct(), "root").groupBy("path_id").agg(F.max_by("root", F.char_length("root")).alias("root"))
    return paths.join(held, "path_id", "left")


#: Fields that are written into files' tags (fixed values).
TAG_FIELDS = ("title", "subtitle", "author", "narrator", "series", "publisher", "language", "description", "release_date", "genre", "asin", "isbn")


def tag_winners(candidates: DataFrame, fields: tuple[str, ...] = TAG_FIELDS) -> DataFrame:
    """Winning candidates (book_id, field, value, is_winner) of the fields that tags have."""
    return candidates.where(F.col("is_winner") & F.col("field").isin(*fields)).select("book_id", "field", "value")


def confirmed(signatures: DataFrame, least: int = 5) -> DataFrame:
    """signatures (verified_via, match_count) with those that silence verified and that matched often enough confirmed."""
    return signatures.withColumn("confirmed", F.coalesce((F.col("verified_via") == "silence") & (F.col("match_count") >= least), F.lit(False)))


def prestripped(books: DataFrame, matches: DataFrame, coverage: DataFrame) -> DataFrame:
    """books (book_id) whose intro was cut before they came: covered so (book_id, coverage), without a candidate or applied match
    (book_id, status)."""
    open_ = matches.where(F.col("status").isin("candidate", "applied")).select("book_id").distinct()
    return books.join(coverage.where("coverage = 'PreStripped'").select("book_id").distinct(), "book_id", "left_semi").join(open_, "book_id", "left_anti")
