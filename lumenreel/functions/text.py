"""Text: tokens, trimming, tag and clip-text composition, subtitles' times."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenreel.schema import FIELDS, GROUPS

NO_STRINGS = "array<string>"


def trim(c: Column) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def ascii_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case; null: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


@lru_cache(maxsize=1)
def plain_letters() -> dict[str, str]:
    """Lower-case Latin letters with one mark to the letters without it, and forms of a letter (as at a word's end) to the letter."""
    out = {}
    for code in range(0xB5, 0x2000):
        letter = chr(code)
        plain = letter.casefold() if len(letter.casefold()) == 1 else letter
        parts = unicodedata.normalize("NFD", plain)
        if len(parts) == 2 and unicodedata.category(parts[1]) == "Mn" and parts[0].isascii() and parts[0].isalpha():
            plain = parts[0]
        if letter == letter.lower() and plain != letter:
            out[letter] = plain
    return out


#: Marks that stand after a letter as characters of their own.
MARKS = "[\u0300-\u036f]"


def folded(c: Column) -> Column:
    """Lower case, and Latin letters without their diacritics. Null: empty."""
    letters = plain_letters()
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.regexp_replace(F.translate(low, "".join(letters), "".join(letters.values())), MARKS, "")


def unicode_tokens(c: Column) -> Column:
    """Runs of letters and numbers of any script, folded; scripts without spaces aren't cut into words."""
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def plain_query_tokens(value: str) -> list[str]:
    """unicode_tokens() of a query, on the driver: runs of letters, numbers and private-use characters."""
    letters = plain_letters()
    out, run = [], ""
    for c in re.sub(MARKS, "", "".join(letters.get(x, x) for x in value.lower())) + " ":
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def distinct_tags(*parts: Column) -> Column:
    """Trimmed non-empty distinct values of arrays and strings, in order of first appearance."""
    arrays = [F.coalesce(p, F.array().cast(NO_STRINGS)) for p in parts]
    return F.array_distinct(F.filter(F.transform(F.concat(*arrays), trim), lambda x: x.isNotNull() & (x != "")))


def compose_tags(columns: dict[str, Column]) -> Column:
    """Tags of a clip from its descriptive fields."""
    parts = [columns[f.name] if f.is_array else F.array(columns[f.name]) for f in FIELDS if f.in_tags and f.name in columns]
    return distinct_tags(*parts)


def tags_or_composed(tags: Column, columns: dict[str, Column]) -> Column:
    return F.when(F.size(F.coalesce(tags, F.array().cast(NO_STRINGS))) > 0, tags).otherwise(compose_tags(columns))


def joined(parts: list[Column], separator: str) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), separator)


def compose_text(columns: dict[str, Column], transcript: Column | None = None) -> Column:
    """The text of a clip that is embedded: groups of fields, then the transcript."""
    groups = []
    for group, separator in GROUPS.items():
        own = [f for f in FIELDS if f.group == group and f.name in columns]
        parts = [F.array_join(F.filter(columns[f.name], lambda x: x != ""), ", ") if f.is_array else columns[f.name] for f in own]
        if parts:
            groups.append(joined(parts, separator))
    return joined(groups + ([transcript] if transcript is not None else []), ". ")


def merge_fields(local: dict[str, Column], remote: dict[str, Column]) -> dict[str, Column]:
    """Remote values win: strings if not null, arrays if not empty; tags are composed anew."""
    out = {}
    for f in FIELDS:
        if f.name in local and f.name in remote:
            out[f.name] = F.when(F.size(F.coalesce(remote[f.name], F.array().cast(NO_STRINGS))) > 0, remote[f.name]).otherwise(local[f.name]) if f.is_array else F.coalesce(remote[f.name], local[f.name])
    return out | {"tags": compose_tags(out)}


def tags_to_text(tags: Column) -> Column:
    """A JSON array of strings as words joined by a space; anything else as it is."""
    return F.coalesce(F.array_join(F.from_json(tags, NO_STRINGS), " "), tags)


def json_salvage(text: Column, schema: str) -> Column:
    """A record from text that a model wrote: without code fences, from the first { to the last }."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"```(?:json)?", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), schema)


def response_text(body: Column) -> Column:
    """The text of a model service's answer."""
    return F.get_json_object(body, "$.candidates[0].content.parts[0].text")


def response_error(body: Column) -> Column:
    return F.get_json_object(body, "$.error.message")


def embedding_values(body: Column) -> Column:
    return F.from_json(F.get_json_object(body, "$.embedding.values"), "array<float>")


def embeddings_values(body: Column) -> Column:
    found = F.from_json(body, "embeddings array<struct<values:array<float>>>")["embeddings"]
    return F.transform(found, lambda x: x["values"])


def srt_time(seconds: Column) -> Column:
    """hh:mm:ss,mmm; below 0 is 0, milliseconds are cut off."""
    ms = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    whole = F.floor(ms / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600).cast("long"), (F.floor(whole / 60) % 60).cast("long"), whole % 60, ms % 1000)


def srt_seconds(stamp: Column) -> Column:
    """Seconds of hh:mm:ss,mmm (or a point); null if it isn't one."""
    pattern = r"^\s*(\d+):(\d+):(\d+)[,.](\d+)\s*$"
    part = [F.regexp_extract(stamp, pattern, i).try_cast("double") for i in range(1, 5)]
    return F.when(stamp.rlike(pattern), part[0] * 3600 + part[1] * 60 + part[2] + part[3] / 1000)


def timecode(seconds: Column, hundredths: bool = False) -> Column:
    """m:ss, or m:ss.cc."""
    minutes = F.floor(seconds / 60).cast("long")
    if hundredths:
        return F.format_string("%d:%05.2f", minutes, seconds - minutes * 60)
    return F.format_string("%d:%02d", minutes, F.floor(seconds).cast("long") % 60)


def spoken(text: Column) -> Column:
    """Without <|...|> marks and surrounding blanks; empty without a letter or digit."""
    bare = trim(F.regexp_replace(text, r"<\|[^|]*\|>", ""))
    return F.when(bare.rlike(r"[\p{L}\p{Nd}]"), bare).otherwise(F.lit(""))


def utc_text(ts: Column) -> Column:
    """A time as `yyyy-MM-dd HH:mm:ss` in the session's time zone, which is to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def utc_time(text: Column) -> Column:
    """The time that utc_text() wrote; null of anything else."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))


def is_key(text: Column, least: int = 10) -> Column:
    """Whether a text has the shape of a service's key: so many characters without surrounding blanks."""
    return F.char_length(trim(F.coalesce(text, F.lit("")))) >= least


def path_hash(path: str) -> str:
    """A string's djb2 hash in 64 bits, as hexadecimal digits."""
    return format(reduce(lambda h, b: (h * 33 + b) & (2**64 - 1), path.encode(), 5381), "016x")


@F.pandas_udf(T.StringType())
def path_hashes(path: pd.Series) -> pd.Series:
    return path.map(lambda p: None if p is None else path_hash(p))
