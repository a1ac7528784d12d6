"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filename_slug(title: Column, most: int = 80, default: str = "book") -> Column:
    """Runs of other than letters, digits, dot, dash and underscore as one dash; trimmed, cut, never empty."""
    slug = F.btrim(F.substring(F.btrim(F.regexp_replace(title, r"[^A-Za-z0-9._]+", "-"), F.lit("-")), 1, most), F.lit("-"))
    return F.when(F.coalesce(slug, F.lit("")) == "", F.lit(default)).otherwise(slug)


def slugify(text: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one dash, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def tag(text: Column) -> Column:
    """A tag: ASCII letters and digits in lower case, dashes and underscores as one dash, the rest dropped."""
    kept = F.regexp_replace(F.lower(text), "[^a-z0-9_-]", "")
    return F.btrim(F.regexp_replace(kept, "[-_]+", "-"), F.lit("-"))


def setting_tag(text: Column) -> Column:
    """As tag, but white space too becomes a dash."""
    kept = F.regexp_replace(F.lower(text), "[^a-z0-9 \t_-]", "")
    return F.btrim(F.regexp_replace(kept, "[ \t_-]+", "-"), F.lit("-"))


def clamp_tags(tags: Column, most: int, normal=tag) -> Column:
    """Normalised, without blanks, distinct in order of appearance, at most `most`."""
    return F.slice(F.array_distinct(F.filter(F.transform(tags, normal), lambda t: t != "")), 1, most)


def normal_words(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def duration_text(secs: Column) -> Column:
    """`Xh Ym`, `Xm Ys` or `Zs`."""
    h, m, s = F.floor(secs / 3600), F.floor(secs % 3600 / 60), secs % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def grouped_integer(value: Column, separator: str = ",") -> Column:
    """Digits in groups of three."""
    return F.translate(F.format_number(value, 0), ",", separator)


#: Month names by locale (fixed values).
MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split(),
}


def long_date(day: Column, locale: str = "en") -> Column:
    """A date with its month's name, in the order of the locale."""
    month = F.element_at(F.array(*map(F.lit, MONTHS.get(locale, MONTHS["en"]))), F.month(day))
    d, y = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    if locale == "de":
        return F.concat(d, F.lit(". "), month, F.lit(" "), y)
    if locale == "es":
        return F.concat(d, F.lit(" de "), month, F.lit(" de "), y)
    if locale in ("fr", "it"):
        return F.concat_ws(" ", d, month, y)
    return F.concat(month, F.lit(" "), d, F.lit(", "), y)


#: Short month names by locale (fixed values).
SHORT_MONTHS = {
    "en": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Jan. Feb. März Apr. Mai Juni Juli Aug. Sep. Okt. Nov. Dez.".split(),
    "fr": "janv. févr. mars avr. mai juin juil. août sept. oct. nov. déc.".split(),
    "es": "ene. feb. mar. abr. may. jun. jul. ago. sept. oct. nov. dic.".split(),
    "it": "gen. feb. mar. apr. mag. giu. lug. ago. set. ott. nov. dic.".split(),
}


def date_text(secs: Column, locale: str = "en", style: str = "long") -> Column:
    """A time in seconds as a date, short, medium or long, in the order of the locale's language (UTC); 0 and null are a dash."""
    lang = locale.split("-")[0].split("_")[0].lower()
    day = F.timestamp_seconds(secs)
    d, m, y = F.dayofmonth(day), F.month(day), F.year(day)
    if style == "short":
        order = {"en": ("%02d/%02d/%d", m, d, y), "de": ("%02d.%02d.%d", d, m, y)}.get(lang, ("%02d/%02d/%d", d, m, y) if lang in ("fr", "es", "it") else ("%04d-%02d-%02d", y, m, d))
        out = F.format_string(order[0], *order[1:])
    elif style == "medium":
        month = F.element_at(F.array(*map(F.lit, SHORT_MONTHS.get(lang, SHORT_MONTHS["en"]))), m)
        out = F.format_string("%s %d, %d", month, d, y) if lang == "en" else F.format_string("%d. %s %d" if lang == "de" else "%d %s %d", d, month, y)
    else:
        # A locale without months of its own has English ones, day first.
        month = F.element_at(F.array(*map(F.lit, MONTHS["en"])), m)
        out = long_date(day, lang) if lang in MONTHS else F.format_string("%d %s %d", d, month, y)
    return F.when(secs.isNull() | (secs == 0), "—").otherwise(out)


def datetime_text(secs: Column, locale: str = "en", style: str = "long") -> Column:
    """date_text with the time: of 12 hours in English but for en-GB, else of 24."""
    at = F.timestamp_seconds(secs)
    h = F.hour(at)
    twelve = locale.split("-")[0].split("_")[0].lower() == "en" and locale.lower() != "en-gb"
    clock = F.format_string("%d:%02d %s", (h + 11) % 12 + 1, F.minute(at), F.when(h < 12, "AM").otherwise("PM")) if twelve else F.format_string("%02d:%02d", h, F.minute(at))
    return F.when(secs.isNull() | (secs == 0), "—").otherwise(F.concat(date_text(secs, locale, style), F.lit(" "), clock))


def split_values(text: Column) -> Column:
    """Parts between ; / , and |, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, "[;/,|]"), lambda x: F.trim(x)), lambda x: x != "")


def strip_subtitle(title: Column, subtitle: Column) -> Column:
    """The title without a trailing `: subtitle` or ` - subtitle` (in any case of letters), if something is left."""
    n = F.char_length(title) - F.char_length(subtitle)
    ends = (n > 0) & (F.lower(title).endswith(F.lower(subtitle))) & (F.char_length(subtitle) > 0)
    head = F.rtrim(F.substring(title, F.lit(1), n))
    cut = F.regexp_replace(head, r"\s*[:\-–—]\s*$", "")
    return F.when(ends & (cut != head) & (cut != ""), cut)


#: Named entities that stripping decodes (fixed values).
ENTITIES = {"nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def decoded(text: Column) -> Column:
    """text with entities decoded, each once: those named above and numbers of characters, in decimal or hexadecimal digits; others, and
    numbers that no character has, stay as they are. An entity is what stands between & and the next ; within 16 characters."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)&[^;]{0,14};|&|[^&]+"), F.lit(0))
    digits = lambda x: F.regexp_extract(x, r"^&#\+?(\d{1,10});$", 1)
    hexed = lambda x: F.regexp_extract(x, r"^&#[xX]\+?([0-9a-fA-F]{1,10});$", 1)

    def one(x: Column) -> Column:
        code = F.when(digits(x) != "", digits(x).cast("bigint")).when(hexed(x) != "", F.conv(hexed(x), 16, 10).cast("bigint"))
        good = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.when(~x.startswith("&"), x)
        for name, said in ENTITIES.items():
            out = out.when(x == f"&{name};", said)
        return out.when(good, char).otherwise(x)

    return F.array_join(F.transform(parts, one), "")


def strip_html(html: Column) -> Column:
    """The text of a page's body: comments and tags out, entities decoded, white space collapsed."""
    body = F.regexp_replace(html, r"(?is)^.*?<body[^>]*>|</body>.*$", "")
    body = F.regexp_replace(body, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.btrim(F.regexp_replace(decoded(body), r"(?U)\s+", " "))
