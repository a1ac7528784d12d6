"""Codes: languages and their names, genres, media types, release states, dates."""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Languages with a code of their own (fixed values). Names and three-letter codes come from the JVM's locale data.
LANGUAGES = "en de fr es it pt nl sv no da fi is pl cs ru uk tr ja ko hi ar he el".split()
#: Spellings that locale data doesn't have (fixed values).
SPELLINGS = {
    "ger": "de", "fre": "fr", "francais": "fr", "espanol": "es", "castellano": "es", "portugues": "pt", "dut": "nl", "nob": "no", "nno": "no", "ice": "is", "islenska": "is",
    "cze": "cs", "cestina": "cs", "russkij": "ru", "turkce": "tr", "iw": "he", "gre": "el", "zh": "zh", "zho": "zh", "chi": "zh", "chinese": "zh", "mandarin": "zh", "中文": "zh",
}
#: Names of Chinese by locale, English first (fixed values).
CHINESE = {
    "zh-Hans": {"en": "Mandarin (Simplified)", "de": "Mandarin (Vereinfacht)", "fr": "Mandarin (Simplifié)", "es": "Mandarín (Simplificado)"},
    "zh-Hant": {"en": "Mandarin (Traditional)", "de": "Mandarin (Traditionell)", "fr": "Mandarin (Traditionnel)", "es": "Mandarín (Tradicional)"},
    "zh": {"en": "Mandarin", "de": "Mandarin", "fr": "Mandarin", "es": "Mandarín"},
}
UI_LOCALES = ("en", "de", "fr", "es")


def mapped(key: Column, table: dict[str, str]) -> Column:
    """The value of a small table at key, or null."""
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(1)
def _locales(_: int) -> tuple[dict[str, str], dict[tuple[str, str], str]]:
    locale = SparkSession.getActiveSession()._jvm.java.util.Locale
    spellings, names = dict(SPELLINGS), {(c, x): n for c, own in CHINESE.items() for x, n in own.items()}
    for code in LANGUAGES:
        at = locale.forLanguageTag(code)
        own = at.getDisplayLanguage(at)
        for spelling in (code, at.getISO3Language(), at.getDisplayLanguage(locale.ENGLISH), own):
            spellings[spelling.lower()] = code
        for x in UI_LOCALES:
            name = at.getDisplayLanguage(locale.forLanguageTag(x))
            names[code, x] = name[:1].upper() + name[1:]
    return spellings, names


def language_code(text: Column) -> Column:
    """The code of a language given by code, three-letter code, English or own name, with or without a region; with its
    script for Chinese. Null if it isn't known."""
    word = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    primary = F.substring_index(ascii_lower(word), "-", 1)
    script = F.get(F.split(word, "-"), 1)
    scripted = F.concat(primary, F.lit("-"), F.upper(F.substring(script, 1, 1)), F.lower(F.substring(script, F.lit(2), F.char_length(script))))
    return F.when(scripted.isin("zh-Hans", "zh-Hant"), scripted).otherwise(mapped(primary, _locales(0)[0]))


def language_name(code: Column, locale: str = "en") -> Column:
    """The name of a language code in one of UI_LOCALES (with or without a region), else in English; Unknown for others."""
    short = locale.split("-")[0].lower()
    names = {c.lower(): n for (c, x), n in _locales(0)[1].items() if x == (short if short in UI_LOCALES else "en")}
    return F.coalesce(mapped(ascii_lower(code), names), F.lit("Unknown"))


#: Genres and their spellings as slugs (fixed values).
GENRES = {
    "fantasy": "fantasy fantastik fantastique", "science-fiction": "science-fiction sci-fi scifi sf ciencia-ficcion", "mystery": "mystery krimi mistery", "thriller": "thriller",
    "horror": "horror horreur terror", "romance": "romance liebesroman", "crime": "crime kriminalroman policier crimen",
    "historical-fiction": "historical-fiction historical historischer-roman roman-historique", "literary-fiction": "literary-fiction literary fiction",
    "young-adult": "young-adult ya jugendbuch jeunesse juvenil", "children": "children kids kinderbuch enfance infantil", "biography": "biography biografie biographie biografia",
    "memoir": "memoir memoirs memoiren memoires memorias", "history": "history geschichte histoire historia",
    "self-help": "self-help selfhelp selbsthilfe developpement-personnel autoayuda", "business": "business wirtschaft economie empresa", "science": "science wissenschaft ciencia",
    "philosophy": "philosophy philosophie filosofia", "religion": "religion religious", "poetry": "poetry lyrik poesie poesia", "drama": "drama theatre teatro",
    "adventure": "adventure abenteuer aventure aventura", "humor": "humor humour comedy komedie", "travel": "travel reisen voyage viajes", "cooking": "cooking cookbook kochen cuisine cocina",
    "children-non-fiction": "children-non-fiction childrens-non-fiction kids-nonfiction", "non-fiction": "non-fiction nonfiction sachbuch documentaire",
    "education": "education bildung educacion", "true-crime": "true-crime truecrime", "audiobook-classic": "classic classics klassiker classique clasico",
}


def genre_slug(text: Column) -> Column:
    """Lower-case ASCII letters and digits, apostrophes out, other runs as one dash, trimmed."""
    return F.btrim(F.regexp_replace(ascii_lower(F.regexp_replace(text, "['’]", "")), "[^a-z0-9]+", "-"), F.lit("-"))


def genre_code(text: Column) -> Column:
    """The genre that a text names in one of its spellings, or null."""
    return mapped(genre_slug(text), {spelling: genre for genre, own in GENRES.items() for spelling in own.split()})


#: What a catalogue says of a title without a date (fixed value).
NO_DATE = "2200-01-01T00:00:00Z"


def release_state(release: Column, now: Column) -> Column:
    """released, scheduled (after now), announced (without a date) or unknown, of an RFC 3339 time or a date."""
    text = F.trim(release)
    at = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2}))?$"), F.try_to_timestamp(text))
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").when(text == NO_DATE, "announced").when(at.isNull(), "unknown").when(at > now, "scheduled").otherwise("released")


def in_window(release: Column, today: str, cutoff: str) -> Column:
    """Whether a date string is after today and up to the cutoff, as strings of bytes; null is not."""
    return F.coalesce((release > today) & (release <= cutoff), F.lit(False))


def year_start(now: Column) -> Column:
    """The start of now's year, in UTC, in seconds."""
    return F.unix_seconds(F.date_trunc("year", now))


#: Media types by format (fixed values).
MEDIA_TYPES = {"m4b": "audio/mp4", "m4a": "audio/mp4", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "opus": "audio/ogg", "wav": "audio/wav"}


def media_type(form: Column) -> Column:
    return F.coalesce(mapped(ascii_lower(form), MEDIA_TYPES), F.lit("application/octet-stream"))


def title_sort(title: Column, prefix: Column) -> Column:
    """The title without the prefix of its franchise, where it starts with one and something is left."""
    rest = F.trim(F.substring(title, F.char_length(prefix) + 1, F.char_length(title)))
    return F.when(title.startswith(prefix) & (rest != ""), rest).otherwise(title)


def matching_phrases(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """The publishers of (phrase, publisher) whose phrase the text holds, in any case of letters, in the table's order."""
    low = F.lower(text)
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(who)) for p, who in phrases])))


def pcm16(samples: Column) -> Column:
    """Samples of -1 to 1 as 16-bit numbers: clamped, times 32767, rounded away from zero at halves."""
    return F.transform(samples, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("smallint"))
