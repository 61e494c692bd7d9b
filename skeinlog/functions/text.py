"""Column functions on text: truncation, trimming, tokens, set similarity, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: white space as scripting engines trim it.
WIDE_SPACE = r"[\t-\r    -     　﻿]"
ELLIPSIS = "..."


def trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WIDE_SPACE}+|{WIDE_SPACE}+$", "")


def truncate(x: Column, n: int) -> Column:
    """The first n characters and an ellipsis if there are more."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(ELLIPSIS))).otherwise(x)


def utf16_length(x: Column) -> Column:
    return (F.length(F.encode(x, "UTF-16LE")) / 2).cast("int")


def normalize_line(x: Column) -> Column:
    return F.lower(F.regexp_replace(trim(x), r"\s+", " "))


def title_words(x: Column) -> Column:
    """Lower-cased words of more than two letters or digits. Fixed: the characters that count."""
    plain = F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", "")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 2))


def content_words(x: Column) -> Column:
    """As title_words, without heading marks and with accented Latin letters kept. Fixed: the characters that count."""
    plain = F.regexp_replace(F.lower(x), r"(?m)^#{1,6}\s+", "")
    plain = F.regexp_replace(plain, r"[^a-z0-9À-ɏ\s]", "")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if either is empty or null."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def digest(x: Column, n: int) -> Column:
    """The first n hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(x.cast("binary"), 256), 1, n)


def normalize_enum(x: Column, allowed: list[str], default: str) -> Column:
    return F.when(x.isin(*allowed), x).otherwise(F.lit(default))


def bucket(x: Column, high: float, medium: float) -> Column:
    return F.when(x >= high, "high").when(x >= medium, "medium").otherwise("low")


def ordinal(x: Column, values: list[str]) -> Column:
    """Place of x in values, counted from 0; null for others."""
    out = F.when(x == values[0], 0)
    for i, v in enumerate(values[1:], 1):
        out = out.when(x == v, i)
    return out


def file_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%dB", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%.0fKB", n / 1024))
        .otherwise(F.format_string("%.1fMB", n / (1024 * 1024)))
    )


def decode_project(x: Column) -> Column:
    """Directory name to path: every dash is a slash (lossy)."""
    return F.translate(x, "-", "/")


def encode_project(x: Column) -> Column:
    return F.translate(x, "/", "-")


def template(text: Column, values: dict[str, Column]) -> Column:
    """Every ``{{key}}`` replaced by its value, key after key, literally."""
    for key, value in values.items():
        text = F.replace(text, F.lit("{{" + key + "}}"), value)
    return text


def import_references(line: Column) -> Column:
    """@path references of a line, outside of code spans. Fixed: what a reference looks like."""
    plain = F.regexp_replace(line, r"`[^`]+`", "")
    return F.regexp_extract_all(plain, F.lit(r"(?:^|\s)@([\w./-]+\.[\w]+)"), F.lit(1))


def model_json(raw: Column) -> Column:
    """The JSON value of a model's answer as a variant: the text itself, else a fenced block, else from the first [ to
    the last ]; null if none parses."""
    fenced = F.regexp_extract(raw, r"```(?:json)?\s*\n?([\s\S]*?)\n?\s*```", 1)
    bracketed = F.regexp_extract(raw, r"(\[[\s\S]*\])", 1)
    blank = lambda x: F.when(x != "", x)
    return F.coalesce(F.try_parse_json(blank(trim(raw))), F.try_parse_json(blank(trim(fenced))), F.try_parse_json(blank(bracketed)))


def unwrap_envelope(raw: Column) -> Column:
    """The ``result`` text of an envelope object, else the answer as it came."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.result", "string"), raw)
