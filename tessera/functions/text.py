"""Text functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import APOSTROPHES, STEM_SUFFIXES, STOP_WORDS, STRIP_SUFFIXES

WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
STRIP = "^(.{4,})(?:" + "|".join(STRIP_SUFFIXES) + ")$"
STEM = "^(.{3,}?)(" + "|".join(sorted(STEM_SUFFIXES, key=len, reverse=True)) + ")$"
#: The same on reversed words, so that a word without suffix fails at once; two suffixes leave their ``a`` on the root.
STEM_REVERSED = "^(?:" + "|".join(f"{x[:0:-1]}(?=a.{{3}})" if x in ("aymiz", "aydi") else f"{x[::-1]}(?=.{{3}})" for x in sorted(STEM_SUFFIXES, key=len, reverse=True)) + ")"


def normalize(c: Column) -> Column:
    """Lower case, every apostrophe as the plain one. Each other apostrophe is sought as bytes, which costs less than one pattern over the text."""
    return reduce(lambda low, a: F.replace(low, F.lit(a), F.lit("'")), (a for a in APOSTROPHES if a != "'"), F.lower(c))


def strip_suffix(c: Column) -> Column:
    """One case or plural suffix off, where a root of four signs is left. Words without the last sign of a suffix are left at once."""
    last = sorted({x[-1] for x in STRIP_SUFFIXES})
    return F.when(reduce(or_, (c.endswith(x) for x in last)), F.regexp_replace(c, STRIP, "$1")).otherwise(c)


def raw_words(c: Column) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit(WORD), F.lit(0))


def tokenize(c: Column) -> Column:
    """Normalised words, each without its suffix; null gives null."""
    return F.transform(raw_words(c), strip_suffix)


def _stem_step(r: Column) -> Column:
    """One suffix off a reversed word: what a suffix would leave must be a root of three signs at least."""
    cut = F.regexp_replace(r, STEM_REVERSED, "")
    n = F.length(r)

    def or_short(x: Column) -> Column:
        return (
            F.when(x != r, x)
            .when(r.startswith("im"), F.when(n >= 5, F.substring(r, 3, 1 << 20)).otherwise(r))
            .when(r.startswith("i") & (n >= 6) & ~F.lower(F.substring(r, 2, 1)).isin("a", "e", "i", "o", "u"), F.substring(r, 2, 1 << 20))
            .otherwise(r)
        )

    return F.when(n <= 3, r).otherwise(F.transform(F.array(cut), or_short)[0])


def light_stem(c: Column) -> Column:
    """Suffixes off until none is left. Costly for a word, so run it over a vocabulary and join.

    Each step but the last shortens a word, and one of three signs stays: so its length bounds the steps.
    """
    steps = F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1)))
    start = F.struct(F.reverse(c).alias("r"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        cut = F.transform(F.array(_stem_step(s["r"])), lambda x: F.struct(x.alias("r"), (x == s["r"]).alias("done")))[0]
        return F.when(s["done"], s).otherwise(cut)

    return F.aggregate(steps, start, step, lambda s: F.reverse(s["r"]))


def _tokenized(word: str) -> list[str]:
    import re

    out = []
    for w in re.findall(r"[^\W](?:[\w']*[^\W])?", word.lower()):
        for s in STRIP_SUFFIXES:
            if w.endswith(s) and len(w) - len(s) >= 4:
                w = w[: -len(s)]
                break
        out.append(w)
    return out


def stop_list() -> list[str]:
    """Functional words as they stand and as the tokenizer gives them."""
    return sorted({*STOP_WORDS, *(t for w in STOP_WORDS for t in _tokenized(w))})


def meaningful(tokens: Column) -> Column:
    """Tokens that aren't functional words; all of them where none is left."""
    rest = F.filter(tokens, lambda t: ~t.isin(*stop_list()))
    return F.when(F.size(rest) > 0, rest).otherwise(tokens)


def strict_constraints(c: Column) -> Column:
    """Years and quoted strings of a question, in lower case: each must stand in the evidence."""
    years = F.regexp_extract_all(c, F.lit(r"\b(19[0-9][0-9]|20[0-9][0-9])\b"), F.lit(1))
    return F.transform(F.concat(years, F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1))), F.lower)


def slugify(c: Column, default: str = "chat") -> Column:
    """Words, digits, spaces and hyphens in lower case, runs of spaces as one hyphen, 60 signs at most."""
    kept = F.lower(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\s-]", "")))
    return F.coalesce(F.nullif(F.left(F.regexp_replace(kept, r"[\s_]+", "-"), F.lit(60)), F.lit("")), F.lit(default))


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def parent_prefix(c: Column) -> Column:
    """An id without its last number, ending in a colon; nothing for an empty id."""
    cut = F.regexp_replace(F.trim(c), r"^(.*):[0-9]+$", "$1:")
    return F.when(F.trim(c) == "", F.lit("")).when(cut.endswith(":"), cut).otherwise(F.concat(cut, F.lit(":")))


#: Fixed value: the folder of all projects, as a drive path is written in a session folder's name.
PROJECTS_FOLDER = "claude-projects"


def project_label(folder: Column) -> Column:
    """A label for a session folder: what follows the folder of all projects, or that folder itself, else what follows the
    desktop, else all of it but the drive."""
    f = F.trim(folder)
    below = F.regexp_extract(f, rf"(?i)^[A-Za-z]--{PROJECTS_FOLDER}-(.+)$", 1)
    bare = F.regexp_replace(f, "^[A-Za-z]--", "")
    desk = F.regexp_extract(bare, "(?i)desktop-(.+)$", 1)
    base = F.when(below != "", below).when(f.rlike(rf"(?i)^[A-Za-z]--{PROJECTS_FOLDER}$"), F.lit(PROJECTS_FOLDER)).when(desk != "", desk).otherwise(bare)
    return F.concat(F.lit("cc-"), slugify(base))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{4,}", "\n\n\n")


def first_line(c: Column, n: int = 60) -> Column:
    return F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(n))


def run_length_chain(items: Column) -> Column:
    """``A -> B x2``: neighbours that are equal are counted."""
    state = F.aggregate(
        items,
        F.struct(F.array().cast("array<struct<v:string,n:int>>").alias("runs")),
        lambda s, x: F.struct(
            F.when(
                (F.size(s["runs"]) > 0) & (F.element_at(s["runs"], -1)["v"] == x),
                F.concat(F.slice(s["runs"], 1, F.size(s["runs"]) - 1), F.array(F.struct(x.alias("v"), (F.element_at(s["runs"], -1)["n"] + 1).alias("n")))),
            ).otherwise(F.concat(s["runs"], F.array(F.struct(x.alias("v"), F.lit(1).alias("n"))))).alias("runs")
        ),
    )
    return F.array_join(F.transform(state["runs"], lambda r: F.when(r["n"] > 1, F.concat(r["v"], F.lit(" x"), r["n"].cast("string"))).otherwise(r["v"])), " -> ")


def html_escape(c: Column) -> Column:
    """The five signs that mean something in HTML as references; null as empty."""
    out = F.coalesce(c, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def thousands(c: Column) -> Column:
    return F.format_number(c.cast("long"), 0)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``12.3%`` of the whole; of nothing, 0."""
    share = F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)
    return F.format_string(f"%.{digits}f%%", share)
