"""Full-text search: tokens, postings, substrings, snippets, stated names. Ranked search reads a stored index (search_index)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.names import corrected as nearly
from lectern.operators.names import let
from lectern.sources.versions import kept

K1, B = 1.2, 0.75
#: Letters with marks in the Latin ranges, and what they are without.
_PAIRS = [(c, d) for c in map(chr, range(0xC0, 0x250)) if len(d := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and d != c]
MARKED, PLAIN = "".join(c for c, _ in _PAIRS), "".join(d for _, d in _PAIRS)


def fold(text: Column) -> Column:
    """Lower case without marks (Latin letters, and combining marks everywhere)."""
    return F.regexp_replace(F.translate(F.lower(F.translate(text, MARKED, PLAIN)), MARKED, PLAIN), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def quoted(query: str) -> list[str]:
    """The words of a query, without quotes; an empty query is an error."""
    words = [w for w in (x.replace('"', "") for x in query.split()) if w]
    if not words:
        raise ValueError("the query is empty")
    return words


def sanitised(query: Column) -> Column:
    """A query of letters, digits, dashes and apostrophes, with single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(query, r"[^\p{L}\p{N}'-]+", " "), r"\s+", " "))


def counted(text: Column) -> Column:
    """(term, tf, length) of a text's terms, an array in the terms' order: the tokens sorted once, and the places where runs begin."""
    begins = lambda t: F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: (i == 0) | (i == F.size(t)) | (F.get(t, i) != F.get(t, i - 1)))
    n = lambda x: F.size(x["t"]).cast("long")
    term = lambda x: lambda a, i: F.struct(F.get(x["t"], a).alias("term"), (F.get(x["at"], i + 1) - a).cast("long").alias("tf"), n(x).alias("length"))
    runs = lambda x: F.transform(F.slice(x["at"], F.lit(1), F.size(x["at"]) - 1), term(x))
    return let(F.sort_array(tokens(F.coalesce(text, F.lit("")))), lambda t: let(F.struct(t.alias("t"), begins(t).alias("at")), runs))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): terms are counted within their row, without a shuffle; only rows of a key that comes again are
    added up."""
    again = kept(docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    words = lambda rows: rows.select(key, F.inline(counted(F.col(text)))).select(key, "term", "tf", "length")
    sums = words(docs.join(again, key, "left_semi")).groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    nulls = words(docs.where(F.col(key).isNull())).groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
    return words(docs.where(F.col(key).isNotNull()).join(again, key, "left_anti")).unionByName(sums).unionByName(nulls)


def substring_match(docs: DataFrame, columns: list[str], phrase: str) -> DataFrame:
    """docs where a column holds the phrase, in any case of letters; phrases under 4 bytes match nothing."""
    if len(phrase.encode()) < 4:
        return docs.where("false")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(phrase.lower()))
    return docs.where(hit)


def snippet(text: Column, words: list[str], most: int = 16) -> Column:
    """`most` tokens around the first that is one of the words, these between [match] and [/match], dots where text is left out. The
    first one is found in the text as it is; of its tokens only those shown are looked at."""
    some = "|".join(re.escape(w) for w in words)
    tokens_of = lambda x: F.filter(F.split(x, r"\s+"), lambda t: t != "")
    place = F.regexp_instr(text, F.lit(rf"(?iu)(?<!\S)[^\p{{L}}\p{{N}}\s]*(?:{some})[^\p{{L}}\p{{N}}\s]*(?!\S)"))
    dots = lambda is_some: F.when(is_some, "…").otherwise("")
    hit = lambda x: x.rlike(rf"(?iu)^[^\p{{L}}\p{{N}}]*(?:{some})[^\p{{L}}\p{{N}}]*$")

    def shown(f: Column) -> Column:
        near = F.transform(F.slice(f["t"], f["first"], F.lit(most)), lambda x: F.when(hit(x), F.concat(F.lit("[match]"), x, F.lit("[/match]"))).otherwise(x))
        return F.concat(dots(f["first"] > 1), F.array_join(near, " "), dots(f["first"] + most <= F.size(f["t"])))

    def around(f: Column) -> Column:
        first = F.greatest(F.lit(1), F.least(f["at"] - most // 2, F.size(f["t"]) - most + 1)).cast("int")
        return let(F.struct(f["t"].alias("t"), first.alias("first")), shown)

    both = lambda p: F.struct(tokens_of(text).alias("t"), (F.size(tokens_of(F.substring(text, F.lit(1), p - 1))) + 1).alias("at"))
    return let(place, lambda p: F.when(p > 0, let(both(p), around)))


def corrected(rows: DataFrame, key: str, text: str, names: list[str], most: float = 0.3) -> DataFrame:
    """rows with capitalised words that are nearly one of a few names put right (see names.corrected); of names alike near the first
    counts."""
    known = rows.sparkSession.createDataFrame([(n, -i) for i, n in enumerate(names)], "surface string, freq long")
    return nearly(rows, key, text, known, most)


def stated_names(text: Column) -> Column:
    """Names after `by` and the like in a transcript: (kind, value, confidence), at most two of a kind."""
    name = r"((?:[A-Z]\.|[A-Z][\w'-]+)(?:\s+(?:[A-Z]\.|[A-Z][\w'-]+)){0,3})"
    kinds = (("author", r"(?<!(?:narrated|read|performed|voiced) )\bby " + name, 2, 0.85), ("narrator", r"(?i:\b(?:narrated|read|performed|voiced) by) " + name, 2, 0.9), ("title", r"\bThis is ([^,.;]{1,50})[,.;]", 1, 0.7))

    def said(kind: str, confidence: float):
        return lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("value"), F.lit(confidence).alias("confidence"))

    found = [F.transform(F.slice(F.regexp_extract_all(text, F.lit(p)), 1, n), said(k, c)) for k, p, n, c in kinds]
    return F.filter(F.concat(*found), lambda x: (F.octet_length(x["value"]) <= 50) & (x["value"] != ""))
