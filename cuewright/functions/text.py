"""Text, caption, tag and reply functions: Column to Column, but for the two that need Python (noted)."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright import rules


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def first_match(x: Column, ordered: list[tuple[str, str]], how: str = "contains", default=None) -> Column:
    """The value of the first (pattern, value) that ``x`` contains or starts with."""
    out = None
    for pattern, value in ordered:
        hit = getattr(x, how)(pattern)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last extension; a name that only has a leading dot keeps it."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def similarity_key(path: Column) -> Column:
    """The stem in lower case without one trailing version, rate or take mark."""
    bare = F.regexp_replace(F.lower(stem(path)), r"([-_]v?\d+|_?\d+k|_take\d+)$", "")
    return F.btrim(bare, F.lit("-_ "))


def word_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), r"(?U)\s+"), lambda w: w != ""))


def path_words(path: Column) -> Column:
    return word_set(F.regexp_replace(stem(path), r"[-_.,;()]", " "))


def caption(path: Column, embedded: Column | None = None) -> Column:
    """Words for a file: of its embedded description if there is one (WAV only), else of its name; then its prefix's hint."""
    name = stem(path)
    hint = first_match(F.upper(name), rules.PREFIX_HINTS, "startswith", "")
    words = F.regexp_replace(name, r"[-_.]+", " ")
    words = F.regexp_replace(words, r"(?<=[a-z])(?=[A-Z])", " ")
    words = F.regexp_replace(words, r"(?U)\b(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{3,7}\b", " ")
    words = F.lower(squeeze(F.regexp_replace(words, r"(?U)\b\d+\b", "")))
    if embedded is not None:
        told = F.when(F.lower(path).endswith(".wav"), F.coalesce(embedded, F.lit(""))).otherwise("")
        words = F.when(told != "", squeeze(F.lower(F.regexp_replace(told, r"[-_,;]+", " ")))).otherwise(words)
    return strip(F.concat_ws(" ", words, hint))


def category_of_description(text: Column) -> Column:
    return first_match(F.lower(text), rules.DESCRIPTION_HINTS, "contains", rules.ROOM_TONE)


def parse_reply(raw: Column) -> Column:
    """struct(category, sound_description, silence_required) of a labelled two-line reply.

    A null or blank reply has fixed values; an unlabelled one is described by its first plain line.
    """
    clean = F.regexp_replace(raw, r"(?U)\[img-\d+\]", "")
    clean = F.regexp_replace(clean, "(?s)<思考>.*?</思考>", "")
    clean = F.regexp_replace(clean, "(?s)<thinking>.*?</thinking>", "")
    clean = F.translate(clean, "*", "")
    named = F.upper(F.regexp_extract(clean, r"(?iU)CATEGORY:\s*([\w-]+)", 1))
    told = strip(F.regexp_extract(clean, r"(?idU)DESCRIPTION:\s*(.*)", 1))
    plain = F.filter(
        F.transform(F.split(clean, "\n"), strip),
        lambda s: (s != "") & ~F.upper(s).contains("CATEGORY:") & ~F.upper(s).contains("DESCRIPTION:") & ~F.lower(s).contains("thinking") & ~F.lower(s).contains("analyze"),
    )
    told = F.when(told != "", told).otherwise(F.coalesce(F.get(plain, F.lit(0)), F.lit("")))
    category = F.when((named == "") | (named == rules.UNKNOWN), category_of_description(told)).otherwise(named)
    blank = raw.isNull() | (strip(raw) == "")
    return F.struct(
        F.when(blank, F.lit(rules.ROOM_TONE)).otherwise(category).alias("category"),
        F.when(blank, F.lit(rules.NO_RESPONSE)).otherwise(told).alias("sound_description"),
        F.lit(False).alias("silence_required"),
    )


def labelled_line(text: Column, label: str) -> Column:
    """What follows ``label:`` in the last line that starts with it, whatever its case; null if none does."""
    lines = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda s: F.upper(s).startswith(f"{label}:"))
    return F.when(F.size(lines) > 0, strip(F.substr(F.element_at(lines, -1), F.lit(len(label) + 2))))


def line_categories(text: Column, label: str) -> Column:
    """The last category of the vocabulary that a line of ``label`` names before its first `` - ``."""
    lines = F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda s: F.upper(s).startswith(f"{label}:"))
    named = F.transform(lines, lambda s: F.upper(strip(F.substring_index(strip(F.substr(s, F.lit(len(label) + 2))), " - ", 1))))
    known = F.filter(named, lambda c: c.isin(*rules.VOCABULARY))
    return F.when(F.size(known) > 0, F.element_at(known, -1))


def opposite_of(category: Column) -> Column:
    out = None
    for key, negative in rules.OPPOSITE.items():
        out = F.when(category == key, negative) if out is None else out.when(category == key, negative)
    return out.otherwise(rules.ROOM_TONE)


def check_negative(positive_category: Column, negative: Column, negative_category: Column) -> Column:
    """struct(status, category): whether a negative line can be used, and the category that then holds."""
    danger = None
    for word in rules.DANGER:
        hit = F.lower(negative).contains(word)
        danger = hit if danger is None else danger | hit
    status = (
        F.when(positive_category.isNull(), "invalid_positive")
        .when(negative_category == positive_category, "auto_corrected_same")
        .when(negative_category.isNull(), "auto_corrected_invalid")
        .when((negative != "") & danger, "auto_corrected_danger")
        .otherwise("ok")
    )
    fixed = F.when(status.startswith("auto_corrected"), opposite_of(positive_category)).otherwise(negative_category)
    return F.struct(status.alias("status"), fixed.alias("category"))


def query_text(key: Column, sub: Column, cat: Column, descr: Column, time: Column, perspective: Column) -> Column:
    """Words for a category of the vocabulary; for a key outside it (null ``sub``), the key's own."""
    part = lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.lower(x))
    known = F.concat_ws(" ", F.lower(sub), F.lower(cat), F.substring_index(F.lower(descr), ",", 1), part(time), part(perspective))
    return F.when(sub.isNull(), F.replace(F.lower(key), F.lit("-"), F.lit(" "))).otherwise(known)


def _json_or_none(text: str | None) -> str | None:
    if text is None:
        return None
    found = re.search(r"\{.*\}", text, re.DOTALL)
    try:
        return json.dumps(json.loads(found.group()), ensure_ascii=False, separators=(",", ":")) if found else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def salvage_json(text: pd.Series) -> pd.Series:
    """The text from the first to the last brace, if that is one valid JSON value; else null.

    Python, as Spark's own parsers accept trailing text and refuse repeated keys.
    """
    return text.map(_json_or_none, na_action=None)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; Spark has no such function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x), na_action=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_all(tags: pd.Series) -> pd.Series:
    """``nfkc`` of every text of an array."""
    return tags.map(lambda a: None if a is None else [x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in a], na_action=None)


def clean_tag(tag: Column) -> Column:
    """A tag already in compatibility form: letters, digits, hyphens, apostrophes, single spaces."""
    x = F.regexp_replace(strip(F.lower(tag)), r"<\s*(\d)", "under $1")
    x = F.regexp_replace(x, r">\s*(\d)", "over $1")
    x = F.regexp_replace(F.translate(x, "’", "'"), r"(?U)\s", " ")
    return squeeze(F.regexp_replace(x, r"[^\p{L}\p{N} '-]", ""))


def tags(raw: Column, most: int = 10) -> Column:
    """Distinct cleaned tags of an array, in order of first occurrence, ``most`` at most.

    Tags are brought into compatibility form first (ligatures, full-width letters); plain ASCII has that already, so Python only sees arrays with other letters.
    """
    given = F.coalesce(raw, F.array().cast("array<string>"))
    foreign = F.exists(given, lambda t: F.octet_length(t) != F.char_length(t))
    formed = F.coalesce(nfkc_all(F.when(foreign, given)), given)
    cleaned = F.filter(F.transform(formed, clean_tag), lambda t: (F.char_length(t) > 2) & ~t.isin(*rules.STOP_WORDS))
    return F.slice(F.array_distinct(cleaned), 1, most)


def clamp01(x: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.try_cast("double"), F.lit(default))))


def description_or_layers(description: Column, layers: Column) -> Column:
    """The description, or else the descriptions of the three layers of most weight (first of equals first)."""
    own = strip(F.coalesce(description, F.lit("")))
    told = F.filter(
        F.transform(F.coalesce(layers, F.array()), lambda l, i: F.struct((-F.coalesce(l["weight"].try_cast("double"), F.lit(0.0))).alias("w"), i.alias("i"), strip(F.coalesce(l["description"], F.lit(""))).alias("d"))),
        lambda l: l["d"] != "",
    )
    return F.when(own != "", own).otherwise(F.array_join(F.transform(F.slice(F.array_sort(told), 1, 3), lambda l: l["d"]), " "))


def model_rank(name: Column, size_gb: Column) -> Column:
    """Parameters (of the name, else by size) times the quality that the name's quantisation stands for."""
    low = F.lower(name)
    found = F.regexp_extract(low, r"(\d+\.?\d*)\s*b", 1)
    by_size = F.when(size_gb > 5, 7.0).when(size_gb > 2.5, 4.0).when(size_gb > 1.5, 3.0).otherwise(1.5)
    quality = None
    for mark, score in rules.QUANTISATION:
        quality = F.when(low.contains(mark), score) if quality is None else quality.when(low.contains(mark), score)
    return F.when(found != "", found.try_cast("double")).otherwise(by_size) * quality.otherwise(1.0)


def project_name(path: Column) -> Column:
    return F.translate(stem(path), " ()", "___")


def file_url(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.when(path.startswith("/"), "").otherwise("/"), path)
