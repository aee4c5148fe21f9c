"""Text functions as Spark columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no retrieval meaning.
STOPWORDS = (
    "a an and against at be both for from in into is it must of on or over same should the to use with"
).split()

# A concept and the words that imply it. Listed in definition
# order; where a word appears under two concepts the later one holds.
CONCEPTS = {
    "architecture": "architecture architectural building facade interior room structure tower",
    "sport": "athlete athletic discipline exercise sport training workout",
    "screen": "computer desk display interface laptop monitor monitors screen screens work",
    "walking": "arrival corridor entrance rear walk walking",
    "static": "hold locked nearly seated standing static",
    "night": "dark evening night",
    "warm": "amber cream orange red sunset warm",
    "outdoor": "court environment exterior garden outdoor park pool road sky street",
    "human": "adult athlete face human people person portrait subject",
    "pair": "dance interaction pair paired together two",
    "motion": "action energetic movement moving motion peak walk walking",
    "silhouette": "backlit shadow silhouette",
    "vehicle": "bicycle car motorcycle road transport vehicle",
    "hospitality": "cafe hospitality hotel lobby restaurant venue",
    "water": "court pool water",
    "profile": "profile side",
    "rear": "back rear",
    "wide": "environment establishing fullbody wide",
    "bright": "bright cream day daylight pale white",
}
ALIAS = {word: concept for concept, words in CONCEPTS.items() for word in words.split()}


@F.pandas_udf(T.StringType())
def _fold_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def whole_normal_form(texts: pd.Series) -> pd.Series:
    """:func:`normalize_text` as one Arrow function, for use from SQL."""
    folded = texts.fillna("").map(lambda s: unicodedata.normalize("NFKC", s).casefold())
    return folded.str.replace("[^0-9a-z]+", "", regex=True)


def normalize_text(col: Column) -> Column:
    """Compatibility-normalised, case-folded text reduced to ``[0-9a-z]``; null reads as empty.

    Built-in functions cover ASCII values, and only a column that also holds
    other characters pays for the Arrow function on those rows.
    """
    text = F.coalesce(col, F.lit(""))
    plain = text.rlike(r"^\p{ASCII}*$")
    folded = F.when(plain, F.lower(text)).otherwise(_fold_unicode(F.when(~plain, text)))
    return F.regexp_replace(folded, "[^0-9a-z]+", "")


def normalize_ascii(col: Column) -> Column:
    """:func:`normalize_text` for columns known to be ASCII; stays inside codegen."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^0-9a-z]+", "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row: Spark repeats an expression that a lambda's argument shares with its surroundings."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column) -> Column:
    """Distinct ``[a-z0-9]+`` words of two or more letters, without stopwords, plus their concepts."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), 0)
    kept = F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))
    alias = {**{concept: concept for concept in CONCEPTS}, **ALIAS}
    names = F.array(*[F.lit(w) for w in alias])
    told = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair])
    # One hashed intersection finds the few words that have a concept; only those are looked up.
    concepts = lambda named: F.array_except(F.transform(named, lambda w: F.element_at(told, w)), named)
    return _once(kept, lambda held: F.concat(held, _once(F.array_intersect(held, names), concepts)))


def slug(text: Column) -> Column:
    """Lowercase words joined by single dashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def shortcode(url: Column) -> Column:
    """The media code of a ``/reel/<code>``, ``/reels/``, ``/p/`` or ``/tv/`` address, else null."""
    return F.nullif(F.regexp_extract(url, r"/(?:reel|reels|p|tv)/([A-Za-z0-9_-]+)", 1), F.lit(""))


def path_stem(path: Column) -> Column:
    """Last path part without its extension."""
    base = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def project_id(reference: Column, version: int = 1) -> Column:
    """``reel-<token>-v<n>`` from a shortcode (only lowercased) or the slug of the path's stem."""
    path = F.regexp_extract(reference, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    named = F.coalesce(F.nullif(path, F.lit("")), reference)
    token = F.coalesce(F.lower(shortcode(reference)), F.nullif(slug(path_stem(named)), F.lit("")))
    return F.concat(F.lit("reel-"), token, F.lit(f"-v{version}"))


# Option markers in the order they are tried.
OPTION_MARKERS = [
    r"(?i)(?<![\w.])(?:RULING\s+)?(\d{1,2})\s*=\s*",
    r"(?:(?<=\s)|^)(\d{1,2})\.\s+(?=\S)",
    r"\(([a-hA-H])\)\s*",
]
# Where a label ends and what is trimmed from it.
LABEL_STOP = r"(?<=[^\s\d])[.;!?](?=\s|$)|\n"
EDGE = r"[ \t,;:—–-]+"


def _label(text: Column) -> Column:
    cut = F.trim(F.element_at(F.split(text, LABEL_STOP, 2), 1))
    cut = F.regexp_replace(cut, r"(?i)[\s,;:—–-]+(?:or|and)?[\s,;:—–-]*$", "")
    return F.regexp_replace(cut, f"^{EDGE}|{EDGE}$", "")


def _marked_run(text: Column, marker: str) -> Column:
    """(prefix, options) of the consecutive run 1,2,3… or a,b,c… under one kind of marker."""
    pieces = F.split(F.regexp_replace(text, marker, "\u0001$1\u0002$0\u0003"), "\u0001")
    option = "array<struct<n:string,body:string>>"
    start = F.struct(F.element_at(pieces, 1).alias("prefix"), F.array().cast(option).alias("run"))

    def step(acc: Column, piece: Column) -> Column:
        mark = F.substring_index(piece, "\u0002", 1)
        tail = F.substring_index(piece, "\u0002", -1)
        body, raw = F.substring_index(tail, "\u0003", -1), F.regexp_replace(tail, "\u0003", "")
        value = F.coalesce(mark.try_cast("int"), F.ascii(F.lower(mark)) - 96)
        size = F.size(acc["run"])
        last = F.try_element_at(acc["run"], F.lit(-1))
        grown = F.concat(
            F.slice(acc["run"], F.lit(1), F.greatest(size - 1, F.lit(0))),
            F.array(F.struct(last["n"].alias("n"), F.concat(last["body"], raw).alias("body"))),
        ).cast(option)
        pushed = F.concat(acc["run"], F.array(F.struct(mark.alias("n"), body.alias("body")))).cast(option)
        return (
            F.when(value == size + 1, F.struct(acc["prefix"].alias("prefix"), pushed.alias("run")))
            .when(size == 0, F.struct(F.concat(acc["prefix"], raw).alias("prefix"), acc["run"].alias("run")))
            .otherwise(F.struct(acc["prefix"].alias("prefix"), grown.alias("run")))
        )

    found = F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), start, step)
    options = F.transform(found["run"], lambda o: F.struct(o["n"].alias("n"), _label(o["body"]).alias("label")))
    clean = (F.size(options) >= 2) & F.forall(options, lambda o: o["label"] != "")
    return F.when(clean, F.struct(found["prefix"].alias("prefix"), options.alias("options")))


def parse_options(text: Column) -> Column:
    """Struct ``(prefix, options[(n, label)])``; whole text and no options when there is no clean run."""
    safe = F.translate(F.coalesce(text, F.lit("")), "\u0001\u0002\u0003", "")  # the marks used below
    none = F.struct(safe.alias("prefix"), F.array().cast("array<struct<n:string,label:string>>").alias("options"))
    return F.coalesce(*[_marked_run(safe, m) for m in OPTION_MARKERS], none)


def question_sentence(prefix: Column, has_options: Column) -> Column:
    """The words before the options as one question."""
    sentence = r"(?<=[.!])\s+(?=[A-Z0-9(\"'])"
    text = F.regexp_replace(F.coalesce(prefix, F.lit("")), r"\s+", " ")
    text = F.regexp_replace(text, r"^[ \t—–\-:;,(]+|[ \t—–\-:;,(]+$", "")
    asked = F.element_at(F.split(F.substring_index(text, "?", 1), sentence), -1)
    first = F.regexp_replace(F.element_at(F.split(text, sentence, 2), 1), r"[ .!;:,—–-]+$", "")
    closing = F.when(has_options, " — which one?").otherwise(" — what is your call?")
    empty = F.when(has_options, "Which one?").otherwise("What's your call?")
    return (
        F.when(text == "", empty)
        .when(text.contains("?"), F.concat(F.trim(asked), F.lit("?")))
        .otherwise(F.concat(first, closing))
    )


def term_hits(text: Column, term: Column) -> Column:
    """Non-overlapping, case-folded occurrences; terms of up to three letters need spaces around them."""
    short = F.length(term) <= 3
    needle = F.when(short, F.concat(F.lit(" "), term, F.lit(" "))).otherwise(term)
    hay = F.when(short, F.concat(F.lit(" "), F.lower(text), F.lit(" "))).otherwise(F.lower(text))
    gone = F.length(hay) - F.length(F.replace(hay, needle, F.lit("")))
    return F.floor(gone / F.length(needle))
