"""Timelines: files and chapters of a book, cuts, windows, signature matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def offsets(files: DataFrame, key: str, order: list[str], duration: str) -> DataFrame:
    """files with start_ms, the duration of those before (null and negative count as 0), and end_ms."""
    own = F.greatest(F.coalesce(F.col(duration), F.lit(0)), F.lit(0))
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(own).over(w), F.lit(0))
    return files.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + own)


def position_file(files: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """targets (key, at_ms) with the file that plays then and the offset in it; none outside the book."""
    f = files.select(F.col(key).alias("k"), "file_id", "start_ms", "end_ms")
    hit = (F.col(key) == F.col("k")) & (F.col("at_ms") >= F.col("start_ms")) & (F.col("at_ms") < F.col("end_ms"))
    return targets.join(f, hit, "left").select(key, "at_ms", "file_id", (F.col("at_ms") - F.col("start_ms")).alias("in_file_ms"))


def chapter_ends(chapters: DataFrame, key: str, start: str, end_of_file: str) -> DataFrame:
    """chapters with end_ms: the next start, of the last one the file's end or its own start."""
    w = Window.partitionBy(key).orderBy(start, "idx")
    return chapters.withColumn("end_ms", F.coalesce(F.lead(start).over(w), F.greatest(F.col(start), F.col(end_of_file))))


def monotone(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """rows with `value` never below an earlier one's."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.max(value).over(w))


def shift_for_cut(chapters: DataFrame, cut_start: Column, cut_end: Column, padding: Column) -> DataFrame:
    """chapters after a cut: those from its end on move up, those across it get shorter, those inside stay."""
    cut = F.greatest(F.lit(0), cut_end - cut_start - padding)
    s, e = F.col("start_ms"), F.col("end_ms")
    return chapters.withColumns({
        "start_ms": F.when(s >= cut_end, s - cut).otherwise(s),
        "end_ms": F.when((s >= cut_end) | ((s < cut_start) & (e > cut_end)), e - cut).otherwise(e),
    })


def coverage(durations: Column, last_end: Column, cut: Column, tolerance: int = 1500) -> Column:
    """How embedded chapters cover the files: Full, PreStripped or Ambiguous."""
    return F.when(last_end.isNull() | (F.abs(durations - last_end) <= tolerance), "Full").when(F.abs(durations - cut - last_end) <= tolerance, "PreStripped").otherwise("Ambiguous")


def sample_windows(files: DataFrame, duration: str, parts: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75), seconds: int = 30) -> DataFrame:
    """files with the start of each window that fits."""
    at = F.explode(F.array(*map(F.lit, parts)))
    rows = files.select("*", at.alias("part")).withColumn("start_sec", F.floor(F.col(duration) * F.col("part")))
    return rows.where((F.col(duration) >= seconds) & (F.col("start_sec") + seconds <= F.col(duration)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 32-bit numbers; 32 for each number that one has more."""
    n = F.least(F.size(a), F.size(b))
    bits = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return bits + 32 * F.abs(F.size(a) - F.size(b))


def slide_match(needle: Column, hay: Column) -> Column:
    """(distance, offset) of the place in hay most like the needle, the first of equals; null if it doesn't fit."""
    n, m = F.size(needle), F.size(hay)
    places = F.transform(F.sequence(F.lit(0), m - n), lambda o: F.struct(hamming(needle, F.slice(hay, o + 1, n)).alias("distance"), o.alias("offset")))
    return F.when((n > 0) & (n <= m), F.array_min(places))


def confidence(distance: Column, n: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / (32 * n)))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def cut_before(files: DataFrame, cuts: DataFrame) -> DataFrame:
    """files (book_id, file_id, duration_ms) with before_ms: what plays before each, less the applied cuts (file_id, cut_ms)
    in earlier files."""
    own = cuts.groupBy("file_id").agg(F.sum(F.greatest("cut_ms", F.lit(0))).alias("cut_ms"))
    w = Window.partitionBy("book_id").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce("duration_ms", F.lit(0)) - F.coalesce("cut_ms", F.lit(0))
    return files.join(own, "file_id", "left").withColumn("before_ms", F.coalesce(F.sum(left).over(w), F.lit(0))).drop("cut_ms")


def merged_chapters(files: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapters of a book over its files (book_id, file_id, duration_ms): each file's own (file_id, idx, start_ms, title) up to
    the next one or the file's end, a file without as one part; blank titles are numbered."""
    f = offsets(files, "book_id", ["file_id"], "duration_ms").withColumnRenamed("start_ms", "file_ms").drop("end_ms")
    f = f.withColumn("part", F.row_number().over(Window.partitionBy("book_id").orderBy("file_id")))
    rows = f.join(chapters.select("file_id", "idx", F.col("start_ms").alias("at"), "title"), "file_id", "left")
    own = Window.partitionBy("book_id", "file_id").orderBy("at", "idx")
    end = F.when(F.col("at").isNull(), F.col("duration_ms")).otherwise(F.coalesce(F.lead("at").over(own), F.greatest("at", "duration_ms")))
    rows = rows.withColumn("end", end).where("at IS NOT NULL OR duration_ms > 0")
    nth = F.row_number().over(Window.partitionBy("book_id").orderBy("part", "at", "idx"))
    title = F.when(F.col("at").isNull(), F.concat(F.lit("Part "), "part")).when(F.coalesce(F.trim("title"), F.lit("")) == "", F.concat(F.lit("Chapter "), "nth")).otherwise(F.col("title"))
    return rows.withColumn("nth", nth).select("book_id", "nth", (F.col("file_ms") + F.coalesce("at", F.lit(0))).alias("start_ms"), (F.col("file_ms") + F.col("end")).alias("end_ms"), title.alias("title"))


def chapter_marks(chapters: DataFrame, texts: DataFrame) -> DataFrame:
    """chapters (book_id, idx, start_ms) with the bytes of the book's text (book_id, total_ms, text) that they span: in
    proportion to time, moved to the start of a word, never before the one before; the first starts at 0."""
    rows = chapters.join(texts, "book_id").where("total_ms > 0 AND octet_length(text) > 0")
    # Read as Latin-1, a byte is a character.
    raw, n = F.decode(F.col("text").cast("binary"), "ISO-8859-1"), F.octet_length("text")
    at = F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("start_ms") / F.col("total_ms"))) * n), n).cast("int")
    rows = rows.select("book_id", "idx", "start_ms", raw.alias("raw"), n.alias("n"), at.alias("at"))
    blank = F.char_length(F.regexp_extract(F.substring("raw", F.col("at") + 1, F.col("n")), "^[ \\t\\n\\f\\r]+", 0))
    inside = F.char_length(F.regexp_replace(F.substring("raw", F.lit(1), F.col("at")), "[^ \\t\\n\\f\\r]+\\z", ""))
    moved = F.when(F.col("at") >= F.col("n"), F.col("n")).when(blank > 0, F.col("at") + blank).otherwise(inside)
    by = Window.partitionBy("book_id").orderBy("idx")
    rows = rows.withColumn("from_byte", F.when(F.row_number().over(by) == 1, 0).otherwise(moved))
    rows = monotone(rows, "book_id", ["idx"], "from_byte")
    return rows.withColumn("to_byte", F.coalesce(F.lead("from_byte").over(by), F.col("n"))).select("book_id", "idx", "from_byte", "to_byte")


def placeholder(title: Column) -> Column:
    """Whether a chapter's title says nothing: null, blank, a number, or a word like chapter and a number."""
    t = F.trim(title)
    return F.coalesce(t, F.lit("")).rlike(r"(?i)^$|^\d+$|^(chapter|ch\.?|track|part|pt\.?) +\d+[.:]*$")


def paired(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of left (key, order, title) and of right by place, as `title` and `other`, of keys with as many of both."""
    nth = lambda df, name: df.select(key, F.col("title").alias(name), F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("nth"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    return nth(left, "title").join(nth(right, "other"), [key, "nth", "n"])


def titled(winners: DataFrame, spare: DataFrame, key: str, order: str) -> DataFrame:
    """Titles of winners with placeholders replaced by spare's titles, of keys where both have as many and half or more are
    placeholders."""
    rows = paired(winners, spare, key, order).withColumn("empty", placeholder(F.col("title")))
    poor = F.count_if("empty").over(Window.partitionBy(key)) * 2 >= F.col("n")
    return rows.withColumn("poor", poor).where("poor").select(key, "nth", F.when(F.col("empty") & (F.coalesce("other", F.lit("")) != ""), F.col("other")).otherwise(F.col("title")).alias("title"))


def bookend(rows: DataFrame, most_gap: int | None = None) -> DataFrame:
    """rows (head, tail, hashes) with `ends`, the head's best place in hashes and then the tail's best after its end: head_distance,
    head_offset, tail_distance, tail_offset; null if either doesn't fit or the gap between is over most_gap."""
    after = F.col("first.offset") + F.size("head")
    # Exploded, each match is computed once: a filter on it isn't moved below, where it would be computed again.
    once = lambda x: F.explode(F.array(x))
    rows = rows.withColumn("first", once(slide_match(F.col("head"), F.col("hashes"))))
    rows = rows.withColumn("second", once(slide_match(F.col("tail"), F.slice("hashes", after + 1, F.greatest(F.size("hashes") - after, F.lit(0))))))
    gap = F.lit(True) if most_gap is None else F.col("second.offset") <= most_gap
    out = F.struct(F.col("first.distance").alias("head_distance"), F.col("first.offset").alias("head_offset"), F.col("second.distance").alias("tail_distance"), (F.col("second.offset") + after).alias("tail_offset"))
    return rows.withColumn("ends", F.when(F.col("first").isNotNull() & F.col("second").isNotNull() & gap, out)).drop("first", "second")


def detected(windows: DataFrame, signatures: DataFrame, most_gap: int | None = None) -> DataFrame:
    """Per window (window_id, kind, hashes) the best of its kind's signatures (signature_id, kind, hashes, head, tail, threshold), a
    library of bounded size: whole matches of at least the signature's threshold; without one, bookend matches, of
    which the worse end counts. Ties go to the smaller id."""
    pairs = windows.join(signatures.withColumnRenamed("hashes", "own"), "kind").withColumn("hit", F.explode(F.array(slide_match(F.col("own"), F.col("hashes")))))
    best = lambda df: df.where("confidence >= threshold").groupBy("window_id").agg(F.min(F.struct((-F.col("confidence")).alias("worst"), "signature_id")).alias("b"))
    full = best(pairs.withColumn("confidence", confidence(F.col("hit.distance"), F.size("own")))).select("window_id", "b.signature_id", F.lit("full").alias("method"), (-F.col("b.worst")).alias("confidence"))
    both = F.least(confidence(F.col("ends.head_distance"), F.size("head")), confidence(F.col("ends.tail_distance"), F.size("tail")))
    rest = windows.join(full.select("window_id"), "window_id", "left_anti").join(signatures.drop("hashes"), "kind")
    ends = best(bookend(rest, most_gap).where("ends IS NOT NULL").withColumn("confidence", both)).select("window_id", "b.signature_id", F.lit("bookend").alias("method"), (-F.col("b.worst")).alias("confidence"))
    return full.unionByName(ends)


def best_cosine(needle: Column, hay: Column) -> Column:
    """(cosine, offset) of the place in hay with the largest cosine to the needle, the first of equals."""
    n, m = F.size(needle), F.size(hay)
    places = F.transform(F.sequence(F.lit(0), m - n), lambda o: F.struct(cosine(needle, F.slice(hay, o + 1, n)).alias("cosine"), (-o).alias("back")))
    best = F.array_max(places)
    return F.when((n > 0) & (n <= m), F.struct(best["cosine"].alias("cosine"), (-best["back"]).alias("offset")))


def compatible(a: Column, b: Column) -> Column:
    """Whether two publishers may be one: equal, or one within the other, in any case of letters; blank with none."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def windows_at(files: DataFrame, parts: tuple[float, ...], seconds: int, key: str = "book_id") -> DataFrame:
    """Sample windows of a book: at each part of its whole length, in the file that plays then, not past its end, of over a
    second. files (key, file_id, start_ms, end_ms) as offsets() gives."""
    total = files.groupBy(key).agg(F.max("end_ms").alias("total"))
    at = total.select(key, F.explode(F.array(*map(F.lit, parts))).alias("part"), "total").withColumn("at_ms", F.floor(F.col("total") * F.col("part")))
    rows = at.join(files, key).where("at_ms >= start_ms AND at_ms < end_ms")
    rows = rows.select(key, "file_id", "part", (F.col("at_ms") - F.col("start_ms")).alias("from_ms"), F.least(F.lit(seconds * 1000), F.col("end_ms") - F.col("at_ms")).alias("length_ms"))
    return rows.where("length_ms > 1000")


#: Transitions of a match's review and the least confidence at which a method applies itself (fixed values).
TRANSITIONS = {"candidate": ("applied", "rejected", "re_detected"), "applied": ("rejected", "re_detected")}
FLOORS = {"fingerprint_full": 0.85, "fingerprint_bookend": 0.80, "manual": 0.0}


def may_become(status: Column, to: Column) -> Column:
    out = F.lit(False)
    for at, others in TRANSITIONS.items():
        out = out | ((status == at) & to.isin(*others))
    return F.coalesce(out, F.lit(False))


def applies_itself(method: Column, certainty: Column) -> Column:
    out = F.lit(False)
    for name, least in FLOORS.items():
        out = out | ((method == name) & (certainty >= least))
    return F.coalesce(out, F.lit(False))


def stated_phrase(segments: DataFrame, phrases: list[str], head_ms: int = 60_000, tail_ms: int = 30_000) -> DataFrame:
    """(book_id, place, phrase, at_ms): the earliest phrase in the first head_ms and in the last tail_ms of a book's
    segments (book_id, idx, start_ms, end_ms, text), in any case of letters, and the start of the segment that it begins in.
    Segments of a book are joined with blanks; ties go to the phrase that comes first in the table."""
    last = Window.partitionBy("book_id")
    rows = segments.withColumn("total", F.max("end_ms").over(last))
    ends = rows.select("book_id", "idx", "start_ms", "text", F.explode(F.array_compact(F.array(
        F.when(F.col("start_ms") < head_ms, "head"), F.when(F.col("end_ms") > F.col("total") - tail_ms, "tail")))).alias("place"))
    by = Window.partitionBy("book_id", "place").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("low", F.lower(F.coalesce("text", F.lit("")))).withColumn("from", F.coalesce(F.sum(F.char_length("low") + 1).over(by), F.lit(0)))
    joined = ends.groupBy("book_id", "place").agg(F.array_sort(F.collect_list(F.struct("idx", "from", "start_ms", "low"))).alias("s"))
    whole = F.array_join(F.transform("s", lambda x: x["low"]), " ")
    hits = F.array_compact(F.array(*[F.when(F.instr(F.col("whole"), p.lower()) > 0, F.struct((F.instr(F.col("whole"), p.lower()) - 1).alias("at"), F.lit(i).alias("i"), F.lit(p).alias("phrase"))) for i, p in enumerate(phrases)]))
    found = joined.withColumn("whole", whole).withColumn("hit", F.array_min(hits)).where("hit IS NOT NULL")
    own = F.element_at(F.filter("s", lambda x: x["from"] <= F.col("hit.at")), -1)
    return found.select("book_id", "place", "hit.phrase", own["start_ms"].alias("at_ms"))
