"""Names in texts: capitalised runs, the corpus' own dictionary, near misses put right, names found in places of a text.

All are column expressions and joins on equal keys: dictionaries can be of any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.versions import kept

WORD = r"\p{L}[\p{L}\p{N}_'’]*"
#: Letters of the first look at a place of a text, and numbers of letters that names are looked up by.
GRAM, LEADS = 4, (1, 2, 3, 4, 6, 9, 13, 19, 28)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def capitalised_runs(text: Column) -> Column:
    """Runs of capitalised words as names, with one blank between their words; a single one that begins a sentence is none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD + r"|[.!?\n]"), F.lit(0))
    first = lambda x: F.substring(x, 1, 1)
    upper = lambda x: (F.upper(first(x)) == first(x)) & (F.lower(first(x)) != first(x))
    ends = lambda x: x.isin(".", "!", "?", "\n")

    def runs(t: Column) -> Column:
        places = lambda edge: F.filter(F.transform(t["up"], lambda u, i: F.when(u & edge(i), i)), lambda i: i.isNotNull())
        starts = places(lambda i: (i == 0) | ~F.get(t["up"], i - 1))
        stops = places(lambda i: (i == F.size(t["up"]) - 1) | ~F.get(t["up"], i + 1))
        spans = F.arrays_zip(starts.alias("a"), stops.alias("b"))
        named = F.filter(spans, lambda s: (s["b"] > s["a"]) | ((s["a"] > 0) & ~ends(F.get(t["w"], s["a"] - 1))))
        return F.transform(named, lambda s: F.array_join(F.slice(t["w"], s["a"] + 1, s["b"] - s["a"] + 1), " "))

    return let(found, lambda w: let(F.struct(w.alias("w"), F.transform(w, upper).alias("up")), runs))


def name_dictionary(docs: DataFrame, text: str, least: int = 3) -> DataFrame:
    """(surface, freq) of names that occur `least` times or more."""
    return docs.select(F.explode(capitalised_runs(F.col(text))).alias("surface")).groupBy("surface").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def _segments(word: Column, size: Column, errors: Column) -> Column:
    """(i, start, piece): the word cut into errors + 1 even pieces."""
    at = lambda i: F.floor(i * size / (errors + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), errors), lambda i: F.struct(i.alias("i"), at(i).alias("start"), F.substring(word, at(i) + 1, at(i + 1) - at(i)).alias("piece")))


def nearest_names(words: DataFrame, names: DataFrame, most: float = 0.3) -> DataFrame:
    """(w, name) for each of words (w) that is no name itself and is nearly one of names (surface, freq): by Levenshtein
    distance over the longer one's length, `most` at most. The nearest name counts, ties go to the more frequent, then
    by its letters.

    With e errors at most, one of the name's e + 1 pieces stands unchanged in the word, at most e letters from its place. So
    names post their pieces for each e they can have, words theirs at such places, and only those that share one are measured."""
    errors = lambda n: F.floor(n * F.lit(most) + 1e-9).cast("int")
    single = names.where((F.instr("surface", " ") == 0) & (F.col("surface") != "")).select("surface", "freq", F.char_length("surface").alias("n"))
    longest = F.floor(F.col("n") / (1 - most) + 1e-9).cast("int")
    posted = single.select("surface", "freq", "n", F.explode(F.sequence(errors(F.col("n")), errors(longest))).alias("e")).where("e < n")
    posted = posted.select("surface", "freq", "n", "e", F.explode(_segments(F.col("surface"), F.col("n"), F.col("e"))).alias("s")).select("surface", "freq", "n", "e", F.col("s.i").alias("i"), F.col("s.piece").alias("piece"))
    asked = words.select("w").distinct().join(single.select(F.col("surface").alias("w")), "w", "left_anti").select("w", F.char_length("w").alias("m"))
    asked = asked.where("m > 0")
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("m") * (1 - most) - 1e-9).cast("int")), F.floor(F.col("m") / (1 - most) + 1e-9).cast("int"))
    asked = asked.select("w", "m", F.explode(lengths).alias("n")).withColumn("e", errors(F.greatest("m", "n"))).where("e < n and abs(m - n) <= e")
    cut = lambda i: F.floor(i * F.col("n") / (F.col("e") + 1)).cast("int")
    asked = asked.select("w", "m", "n", "e", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("i")).withColumn("start", cut(F.col("i"))).withColumn("size", cut(F.col("i") + 1) - cut(F.col("i")))
    low, high = F.greatest(F.lit(0), F.col("start") - F.col("e")), F.least(F.col("m") - F.col("size"), F.col("start") + F.col("e"))
    asked = asked.withColumn("low", low).withColumn("high", high).where("low <= high").select("w", "m", "n", "e", "i", F.explode(F.array_distinct(F.transform(F.sequence("low", "high"), lambda p: F.substring(F.col("w"), p + 1, F.col("size"))))).alias("piece"))
    pairs = asked.join(posted, ["n", "e", "i", "piece"]).select("w", "m", "n", "surface", "freq").distinct()
    near = pairs.withColumn("d", F.levenshtein("w", "surface") / F.greatest("m", "n")).where((F.col("d") > 0) & (F.col("d") <= F.lit(most) + 1e-9))
    return near.groupBy("w").agg(F.min_by("surface", F.struct("d", (-F.col("freq")).alias("f"), "surface")).alias("name"))


def corrected(rows: DataFrame, key: str, text: str, names: DataFrame, most: float = 0.3) -> DataFrame:
    """rows (key once each) whose capitalised words that are nearly a name are put right; all else stays as it was."""
    parts = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}\p{N}_'’]+|[^\p{L}\p{N}_'’]+"), F.lit(0))
    words = rows.select(key, F.explode(F.array_distinct(F.filter(parts, lambda w: w.rlike(r"^\p{Lu}")))).alias("w"))
    fixes = words.join(nearest_names(words, names, most), "w").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "name"))).alias("fixes"))
    fixed = F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at("fixes", w), w)), "")
    return rows.join(fixes, key, "left").withColumn(text, F.when(F.col("fixes").isNull(), F.col(text)).otherwise(fixed)).drop("fixes")


def joined_places(segments: DataFrame, head_ms: int, tail_ms: int) -> DataFrame:
    """(book_id, place, s, whole): the text of the first head_ms and of the last tail_ms of a book's segments (book_id, idx, start_ms,
    end_ms, text), in lower case and joined with blanks; s: (idx, from, start_ms, end_ms, low) of each segment in it."""
    last = Window.partitionBy("book_id")
    rows = segments.withColumn("total", F.max("end_ms").over(last))
    ends = rows.select("book_id", "idx", "start_ms", "end_ms", "text", F.explode(F.array_compact(F.array(
        F.when(F.col("start_ms") < head_ms, "head"), F.when(F.col("end_ms") > F.col("total") - tail_ms, "tail")))).alias("place"))
    by = Window.partitionBy("book_id", "place").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("low", F.lower(F.coalesce("text", F.lit("")))).withColumn("from", F.coalesce(F.sum(F.char_length("low") + 1).over(by), F.lit(0)))
    joined = ends.groupBy("book_id", "place").agg(F.array_sort(F.collect_list(F.struct("idx", "from", "start_ms", "end_ms", "low"))).alias("s"))
    return joined.withColumn("whole", F.array_join(F.transform("s", lambda x: x["low"]), " "))


def stated_names(segments: DataFrame, names: DataFrame, head_ms: int = 60_000, tail_ms: int = 30_000) -> DataFrame:
    """(book_id, place, kind, name, start_ms, end_ms): for each place of a book (see joined_places) the name said first, of the
    first kind that has one. names (kind, rank, name): the kind of the least rank wins, then the earliest place in the text, then the
    name by its letters; names are found in any case and within words as well. The times are those of the segments that the
    name begins and ends in, a second apart at least.

    A name is posted under its first letters, as many as the largest of LEADS that it has. Places of a text whose next GRAM letters (or
    fewer) begin no name drop out first, by a table of such beginnings; the others look for their next letters, and are compared with
    the names they meet at once, so no text is copied for each of them."""
    known = names.where("name <> ''").select("kind", "rank", "name", F.lower("name").alias("low")).distinct().withColumn("size", F.char_length("low"))
    known = known.withColumn("g", F.array_max(F.filter(F.array(*map(F.lit, LEADS)), lambda g: g <= F.col("size"))))
    known = kept(known.select("kind", "rank", "name", "low", "size", "g", F.substring(F.col("low"), F.lit(1), F.col("g")).alias("lead")))
    grams = kept(known.groupBy(F.substring("low", 1, GRAM).alias("gram")).agg(F.collect_set("g").alias("gs"), F.max("size").alias("longest")))
    places = kept(joined_places(segments, head_ms, tail_ms))
    at = places.where("whole <> ''").select("book_id", "place", "whole", F.explode(F.sequence(F.lit(1), F.char_length("whole"))).alias("p"))
    next_ = F.array_distinct(F.array(*[F.substring(F.col("whole"), F.col("p"), F.lit(g + 1)) for g in range(GRAM)]))
    said = at.select("book_id", "place", "whole", "p", F.explode(next_).alias("gram")).join(grams, "gram")
    said = said.select("book_id", "place", "p", F.substring(F.col("whole"), F.col("p"), F.col("longest")).alias("tail"), F.explode("gs").alias("g")).where(F.char_length("tail") >= F.col("g"))
    met = said.withColumn("lead", F.substring(F.col("tail"), F.lit(1), F.col("g"))).join(known, ["g", "lead"]).where(F.startswith("tail", "low"))
    hits = met.select("book_id", "place", "kind", "rank", "name", (F.col("p") - 1).alias("at"), "size")
    best = hits.groupBy("book_id", "place").agg(F.min(F.struct("rank", "at", "name", "kind", "size")).alias("hit"))
    found = best.join(places.select("book_id", "place", "s"), ["book_id", "place"])
    begins = F.element_at(F.filter("s", lambda x: x["from"] <= F.col("hit.at")), -1)["start_ms"]
    ends = F.element_at(F.filter("s", lambda x: x["from"] <= F.col("hit.at") + F.col("hit.size")), -1)["end_ms"]
    timed = found.select("book_id", "place", "hit.kind", "hit.name", begins.alias("start_ms"), ends.alias("end_ms"))
    return timed.withColumn("end_ms", F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 1000).otherwise(F.col("end_ms")))
