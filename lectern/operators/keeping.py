"""The library's records as its users keep them: lists and details, pending names, learned numbers, roots, restores, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.codes import ascii_lower
from lectern.functions.scalar import normal_words
from lectern.operators.catalog import display_names
from lectern.operators.state import check, latest


def shown_narrators(members: DataFrame, narrators: DataFrame, aliases: DataFrame) -> DataFrame:
    """(book_id, narrators): the names that a book's narrators go by, once each, joined by commas in order."""
    named = display_names(narrators, aliases, "narrator_id").select("narrator_id", "display")
    return members.select("book_id", "narrator_id").distinct().join(named, "narrator_id").groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_set("display")), ", ").alias("narrators"))


def listed_books(rows: DataFrame, files: DataFrame, members: DataFrame, narrators: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows of the catalogue with file_path, that of the first of a book's files (file_id, book_id, file_path), and narrators. Both sides
    are one row a book before they are joined, so rows stay as many as they were."""
    first = files.groupBy("book_id").agg(F.min_by("file_path", "file_id").alias("file_path"))
    return rows.join(first, "book_id", "left").join(shown_narrators(members, narrators, aliases), "book_id", "left")


def details(rows: DataFrame, files: DataFrame, progress: DataFrame, chapters: DataFrame, characters: DataFrame) -> DataFrame:
    """rows (book_id, ..) with all that a book's page shows: its files in order of file_id, its stages by name with their status, its winning
    chapters counted by source, and whether characters are known."""
    f = files.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("file_id", "format", "size"))).alias("files"))
    s = progress.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("stage", "status"))).alias("stages"))
    c = chapters.where("is_winner").groupBy("book_id", "source").agg(F.count("*").alias("count")).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("source", "count"))).alias("chapters"))
    known = characters.select("book_id").distinct().withColumn("has_characters", F.lit(True))
    out = rows.join(f, "book_id", "left").join(s, "book_id", "left").join(c, "book_id", "left").join(known, "book_id", "left")
    return out.withColumn("has_characters", F.coalesce("has_characters", F.lit(False)))


#: Kinds of names that wait for a choice, in the order in which they are listed (fixed values).
PENDING_KINDS = ("author", "narrator", "series")


def pending_all(kinds: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(kind, pending_id, book_id, observed_alias, place, id, display, score): the open choices of all kinds, as rows a candidate, best
    first (place). kinds: rows (pending_id, book_id, observed_alias, resolved) and candidates (pending_id, id, display, score)."""
    from pyspark.sql.window import Window

    out = None
    for kind in PENDING_KINDS:
        rows, candidates = kinds[kind]
        best = Window.partitionBy("pending_id").orderBy(F.desc_nulls_last("score"), "id")
        own = rows.where("not resolved").join(candidates, "pending_id", "left").withColumn("place", F.when(F.col("id").isNotNull(), F.row_number().over(best)))
        own = own.select(F.lit(kind).alias("kind"), "pending_id", "book_id", "observed_alias", "place", "id", "display", "score")
        out = own if out is None else out.unionByName(own)
    return out


def captured(learned: DataFrame, edits: DataFrame) -> DataFrame:
    """learned (title_norm, author_norm, asin, source, learned_at) with edits (title, author, asin, source, learned_at): a blank part teaches
    nothing, and what is known by all three stays as it was learned first."""
    known = ["title_norm", "author_norm", "asin"]
    new = edits.select(normal_words(F.col("title")).alias("title_norm"), normal_words(F.col("author")).alias("author_norm"), "asin", "source", "learned_at")
    new = new.where("title_norm <> '' and author_norm <> '' and asin <> ''").join(learned.select(*known).distinct(), known, "left_anti")
    new = new.groupBy(*known).agg(F.min(F.struct("learned_at", "source")).alias("first")).select(*known, "first.source", "first.learned_at")
    return learned.select(*new.columns).unionByName(new)


def learned_page(learned: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of what was learned, newest first, with how many there are in all."""
    total = F.broadcast(learned.agg(F.count("*").alias("total")))  # one row
    rows = learned.orderBy(F.desc("learned_at"), "title_norm", "author_norm", "asin").offset(offset).limit(limit)
    return rows.join(total)


def forgotten(learned: DataFrame, gone: DataFrame) -> DataFrame:
    """learned without the rows of gone (title_norm, author_norm, asin)."""
    return learned.join(gone, ["title_norm", "author_norm", "asin"], "left_anti")


def roots_after(roots: DataFrame, requests: DataFrame) -> DataFrame:
    """Library roots (path, label, is_active) after requests (request_id, op, path, label): `add` makes a root or makes one active again,
    under a new label if it gives one, `remove` makes one inactive. Requests for a path count in order; a root is never forgotten,
    and removing one that isn't there does nothing. Trailing slashes are no part of a path."""
    plain = lambda p: F.when(F.col(p).rlike("^/+$"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
    asked = requests.withColumn("path", plain("path")).where("path <> ''")
    last = latest(asked, ["path"], [F.desc("request_id")]).select("path", (F.col("op") == "add").alias("on"))
    labels = asked.where("op = 'add' and label is not null").groupBy("path").agg(F.max_by("label", "request_id").alias("new_label"))
    added = asked.where("op = 'add'").select("path").distinct().withColumn("added", F.lit(True))
    rows = roots.select("path", "label", "is_active", F.lit(True).alias("there")).join(last, "path", "full").join(labels, "path", "left").join(added, "path", "left")
    rows = rows.where("there or added")
    return rows.select("path", F.coalesce("new_label", "label").alias("label"), F.coalesce("on", "is_active").alias("is_active"))


def restored(books: DataFrame, back: DataFrame) -> DataFrame:
    """books with those of back (book_id) no longer deleted."""
    asked = back.select("book_id").distinct().withColumn("back", F.lit(True))
    return books.join(asked, "book_id", "left").withColumn("deleted_at", F.when(F.col("back").isNull(), F.col("deleted_at"))).drop("back")


def purged(books: DataFrame, parts: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """books and the tables of their parts (book_id, ..) without the books of gone (book_id) that are deleted already; others stay."""
    dead = books.where("deleted_at is not null").join(gone.select("book_id").distinct(), "book_id", "left_semi").select("book_id")
    return {n: t.join(dead, "book_id", "left_anti") for n, t in {"books": books, **parts}.items()}


def retried(progress: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(progress, counts): progress (book_id, stage, status) without the failed rows of the stages asked for (stage), and (stage, cleared) of
    each, 0 included."""
    stages = asked.select("stage").distinct()
    failed = progress.where("status = 'failed'").join(stages, "stage", "left_semi")
    counts = stages.join(failed.groupBy("stage").agg(F.count("*").alias("cleared")), "stage", "left").select("stage", F.coalesce("cleared", F.lit(0)).alias("cleared"))
    return progress.join(failed.select("book_id", "stage"), ["book_id", "stage"], "left_anti"), counts


def checks(tables: dict[str, DataFrame], now: Column, known_stages: list[str], days: int = 7) -> DataFrame:
    """(check_name, status, n) of a library's tables: journal (progress, created_at), companions (book_id), winners (book_id, field), stages
    (stage), collections (collection_id, audible_id), members (collection_id, book_id), books (book_id, deleted_at)."""
    journal, members, books = tables["journal"], tables["members"], tables["books"]
    twice = lambda rows, *keys: rows.groupBy(*keys).count().where("count > 1")
    live = books.where("deleted_at is null").select("book_id")
    found = [
        check("pending operations", journal.where("progress = 'pending'"), fails=False),
        check("failed operations", journal.where((F.col("progress") == "failed") & (F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))), fails=False),
        check("unpaired companions", tables["companions"].where("book_id is null"), fails=False),
        check("two winners of a field", twice(tables["winners"], "book_id", "field")),
        check("unknown stages", tables["stages"].select("stage").distinct().where(~F.col("stage").isin(known_stages)), fails=False),
        check("empty collections", tables["collections"].join(members.join(live, "book_id", "left_semi").select("collection_id").distinct(), "collection_id", "left_anti"), fails=False),
        check("members that are deleted", members.join(books.where("deleted_at is not null").select("book_id"), "book_id", "left_semi"), fails=False),
        check("collections of one number", twice(tables["collections"].where("audible_id is not null"), "audible_id")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def entity_order(entities: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """entities (id, name, name_sort, book_count) in one of their orders: by name, by name_sort (the name, if there is none), or by
    book_count and then name; names in any ASCII case, ties by id."""
    name = ascii_lower(F.coalesce("name_sort", "name") if by == "name_sort" else F.col("name"))
    way = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    return entities.orderBy(*([way(F.col("book_count")), name] if by == "book_count" else [way(name)]), "id")


#: How near, in milliseconds, a fingerprint's hit lies to a transcript's that it bears out, and how sure both together are.
NEAR_MS, BOTH = 2000, 0.75


def corroborated(said: DataFrame, prints: DataFrame) -> DataFrame:
    """said (file_id, kind, start_ms, end_ms, method, confidence) with those that a fingerprint of prints (file_id, kind, start_ms) lies near
    raised to both methods' confidence; their own times stay. Times go to buckets of the reach, so the join is on equal keys."""
    bucket = F.floor(F.col("start_ms") / NEAR_MS)
    near = prints.select("file_id", "kind", F.col("start_ms").alias("at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    hit = said.select("file_id", "kind", "start_ms", bucket.alias("bucket")).distinct().join(near, ["file_id", "kind", "bucket"]).where(F.abs(F.col("start_ms") - F.col("at")) <= NEAR_MS)
    both = hit.select("file_id", "kind", "start_ms").distinct().withColumn("both", F.lit(True))
    rows = said.join(both, ["file_id", "kind", "start_ms"], "left")
    return rows.withColumns({"method": F.when(F.col("both"), "fingerprint_and_transcript").otherwise(F.col("method")), "confidence": F.when(F.col("both"), F.lit(BOTH)).otherwise(F.col("confidence"))}).drop("both")


def logo_states(books: DataFrame, matches: DataFrame) -> DataFrame:
    """books (book_id, audiologo_status) with the status that their matches (book_id, status) give: applied before candidate (or detected
    again) before rejected; without matches `stripped` and `none` stay and others are unknown."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    by = matches.groupBy("book_id").agg(F.when(n("applied") > 0, "applied").when(n("candidate", "re_detected") > 0, "detected").when(n("rejected") > 0, "rejected").otherwise("unknown").alias("new"))
    old = F.when(F.col("audiologo_status").isin("stripped", "none"), F.col("audiologo_status")).otherwise("unknown")
    return books.join(by, "book_id", "left").withColumn("audiologo_status", F.coalesce("new", old)).drop("new")


def entity_details(kind: str, entities: DataFrame, members: DataFrame, aliases: DataFrame) -> DataFrame:
    """(kind, id, name, book_count, aliases): entities (id, name) with the number of their books (members: id, book_id), deleted ones too,
    and their aliases (id, alias_id, alias) in the order in which they came."""
    books = members.select("id", "book_id").distinct().groupBy("id").agg(F.count("*").alias("book_count"))
    own = aliases.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("alias_id", "alias"))), lambda a: a["alias"]).alias("aliases"))
    rows = entities.select("id", "name").join(books, "id", "left").join(own, "id", "left")
    return rows.select(F.lit(kind).alias("kind"), "id", "name", F.coalesce("book_count", F.lit(0)).alias("book_count"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def created(collections: DataFrame, requests: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(collections, journal, refused) after requests (request_id, name, fields..) to create collections (name, fields..): texts are trimmed and
    blank ones null, a blank name is refused, and so is one that a collection or an earlier request has in any ASCII case. The journal has
    a row (request_id, field, after) for each value of a new collection."""
    plain = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    asked = requests.select("request_id", plain("name").alias("name"), *[plain(f).alias(f) for f in fields]).withColumn("_key", ascii_lower(F.col("name")))
    free = asked.where("name is not null").join(collections.select(ascii_lower(F.col("name")).alias("_key")).distinct(), "_key", "left_anti")
    first = free.groupBy("_key").agg(F.min("request_id").alias("request_id")).select("request_id")
    new = asked.join(first, "request_id", "left_semi").drop("_key")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("after")) for f in ("name", *fields)]))
    log = new.select("request_id", cells.alias("c")).select("request_id", "c.*").where("after is not null")
    return collections.unionByName(new.drop("request_id")), log, asked.join(first, "request_id", "left_anti").select("request_id")


def added_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """old provenance with new rows (book_id, field, value, source, ..) that no row of the same book, field, value and source is there for; of
    several alike the surest is added."""
    same = ["book_id", "field", "value", "source"]
    rest = [c for c in old.columns if c not in same]
    fresh = new.groupBy(*same).agg(F.max(F.struct("confidence", *[c for c in rest if c != "confidence"])).alias("best")).select(*same, "best.*")
    known = old.select(*[F.col(c).alias(f"_{c}") for c in same]).distinct()
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    on = match[0] & match[1] & match[2] & match[3]
    return old.unionByName(fresh.join(known, on, "left_anti").select(old.columns))


def described(books: DataFrame, detected: DataFrame) -> DataFrame:
    """books (book_id, description, description_lang) with a language found (book_id, lang) for descriptions that aren't blank and have none
    yet; one that is there stays, so a second run changes nothing."""
    found = detected.where("lang is not null").groupBy("book_id").agg(F.min("lang").alias("_lang"))
    wanted = F.col("description_lang").isNull() & (F.trim(F.coalesce("description", F.lit(""))) != "")
    return books.join(found, "book_id", "left").withColumn("description_lang", F.when(wanted, F.col("_lang")).otherwise(F.col("description_lang"))).drop("_lang")


def pending_installs(requests: DataFrame, books: DataFrame, progress: DataFrame) -> DataFrame:
    """(locale, requested_at, blocked): speech models asked for (locale, installed, requested_at) that aren't installed, with how many books that
    aren't deleted (book_id, language, deleted_at) wait for them: those of the locale's language whose progress (book_id, status) is blocked."""
    waits = progress.where("status = 'blocked'").select("book_id").distinct()
    lang = lambda c: ascii_lower(F.substring_index(F.col(c), "-", 1))
    held = books.where("deleted_at is null").join(waits, "book_id", "left_semi").groupBy(lang("language").alias("_lang")).agg(F.count_distinct("book_id").alias("blocked"))
    open_ = requests.where("not installed").groupBy("locale").agg(F.min("requested_at").alias("requested_at")).withColumn("_lang", lang("locale"))
    return open_.join(held, "_lang", "left").select("locale", "requested_at", F.coalesce("blocked", F.lit(0)).alias("blocked"))
