"""One name cleaned: fillers about numbers, ranges in brackets, punctuation, fragments, and a number or day in front split off."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cataloom.functions.titles import let
from cataloom.operators.names import SEPARATORS

# Signs between a number and what it counts, rewritings that go on until nothing changes, replacements in their order, and what
# may stand in front of a name: places skipped, its length, characters that go with it, and its form.
_SIGN, _LETTER, _OPEN, _CLOSE = "(?:[-._,;]|—)", r"\p{L}", r"[(\[{<]", r"[)\]}>]"
SQUEEZED = (
    (rf"([0-9])\s+{_SIGN}+({_LETTER})", "$1 $2"),
    (rf"([0-9]){_SIGN}+\s+({_LETTER})", "$1 $2"),
    (rf"([0-9]){_SIGN}{{2,}}({_LETTER})", "$1 $2"),
    (rf"({_OPEN})\s+([0-9])", "$1$2"),
    (rf"({_OPEN}){_SIGN}+\s+([0-9])", "$1$2"),
    (rf"([0-9])\s+({_CLOSE})", "$1$2"),
    (rf"([0-9])\s+{_SIGN}+({_CLOSE})", "$1$2"),
)
RANGES = (rf"({_OPEN})([0-9]+)\s+([0-9]+)({_CLOSE})", r"()([0-9]+)\s+-([0-9]+)()", r"()([0-9]+)-\s+([0-9]+)()")
REPLACED = (
    (".", " "), (" - ", " "), ("_", " "), ("`", " "), ("'", ""), ('"', ""), ("”", ""), ("“", ""), ("\t", ""), ("\r", ""), ("\n", ""),
    ("｜", " - "), ("：", " - "), ("∶", " - "), ("⧸", "-"), ("#", "Ep."), ("＂", " "), ("？", " "), ("＊", " "), ("•", " "), ("(, ", "("),
)
DAY = "^[12][0-9]{3}([0-9]{4}|-[01][0-9]-[0-3][0-9])$"
PREFIXES = ((0, 10, 10, DAY), (0, 8, 8, DAY), (0, 5, 5, "^[0-9]{2}-[0-9]{2}$"), (0, 4, 4, "^[0-9]{4}$"), (0, 3, 3, "^[0-9]{3}$"), (0, 2, 2, "^[0-9]{2}$"), (1, 2, 4, "^[0-9]{2}$"), (0, 1, 1, "^[0-9]$"))
#: Passes of a rewriting at most; each pass rewrites all places that do not overlap, so two or three are the rule.
MOST_PASSES = 32


def until_same(text: Column, pattern: str, by: str) -> Column:
    """``regexp_replace`` again and again until it changes nothing."""
    once = lambda t: F.regexp_replace(t, pattern, by)
    passes = lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(MOST_PASSES)), t, lambda t, _: F.when(t.rlike(pattern), once(t)).otherwise(t))
    return let(text, lambda t: F.when(t.rlike(pattern), passes(t)).otherwise(t))


def _tightened(text: Column, pattern: str) -> Column:
    """Two numbers, the second no smaller, become a range; brackets about them must be a pair. Other places of the pattern stay as they are."""
    part = lambda m, i: F.regexp_extract(m, pattern, i)
    value = lambda n: F.regexp_replace(n, "^0+(?=.)", "")

    def tight(m: Column) -> Column:
        a, b = value(part(m, 2)), value(part(m, 3))
        rising = (F.length(a) < F.length(b)) | ((F.length(a) == F.length(b)) & (a <= b))
        paired = F.translate(part(m, 1), "([{<", ")]}>") == part(m, 4)
        return F.when(rising & paired, F.concat(part(m, 1), part(m, 2), F.lit("-"), part(m, 3), part(m, 4))).otherwise(m)

    def joined(t: Column) -> Column:
        matches, gaps = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        return F.array_join(F.zip_with(gaps, matches, lambda g, m: F.concat(g, F.coalesce(tight(m), F.lit("")))), "")

    return let(text, lambda t: F.when(t.rlike(pattern), joined(t)).otherwise(t))


def squeezed(name: Column) -> Column:
    """Fillers about numbers taken out: before letters, and inside brackets, which then stand close; two numbers in brackets are a range."""
    done = reduce(lambda t, rule: until_same(t, *rule), SQUEEZED, name)
    return reduce(_tightened, RANGES, done)


def without_fragments(name: Column, fragments: Sequence[str]) -> Column:
    """Fragments taken out in any case of letters, but not from within a run of letters or of digits."""

    def guard(char: str) -> str:
        return "0-9" if char in "0123456789" else "" if re.match(f"[{SEPARATORS}]", char) else f"^0-9{SEPARATORS}"

    for text in fragments:
        if text and not text.startswith("#"):
            before, after = (guard(c) for c in (text[0], text[-1]))
            pattern = (f"(?<![{before}])" if before else "") + r"\Q" + text + r"\E" + (f"(?![{after}])" if after else "")
            name = F.regexp_replace(name, "(?iu)" + pattern, "")
    return name


def split_prefix(name: Column) -> Column:
    """(prefix, rest): the longest number or day in front, with digits and dashes between digits that go on from it; the prefix is empty if there is none."""
    found = F.struct(F.lit("").alias("prefix"), name.alias("rest"))
    for skipped, size, gone, form in reversed(PREFIXES):
        own, rest = F.substring(name, skipped + 1, size), F.substring(name, gone + 1, 1 << 30)
        holds = own.rlike(form)
        if gone != size:  # what goes besides the number must be separators, and no other digit may follow
            about = F.concat(F.substring(name, 1, skipped), F.substring(name, skipped + size + 1, gone - skipped - size))
            holds = holds & ~about.rlike(f"[^{SEPARATORS}]") & ~rest.rlike("^[0-9]")
            pair = F.struct(own.alias("prefix"), rest.alias("rest"))
        else:
            more = F.regexp_extract(rest, "^[0-9]*(?:-[0-9]+)*", 0)
            pair = F.struct(F.concat(own, more).alias("prefix"), F.substring(rest, F.length(more) + 1, F.lit(1 << 30)).alias("rest"))
        found = F.when(holds, pair).otherwise(found)
    return found


def settled(name: Column) -> Column:
    """Single spaces, none at the ends, no dashes, points, slashes or underscores at the end (in this order), no dash in front."""
    tidy = lambda t: F.regexp_replace(F.regexp_replace(t, " {2,}", " "), r"^\s+|\s+$", "")
    bare = reduce(lambda t, sign: F.regexp_replace(t, rf"\{sign}+$", ""), "-./_", tidy(name))
    return F.regexp_replace(tidy(bare), "^- ", "")


def clean_name(name: Column, fragments: Sequence[str] = ()) -> Column:
    """(prefix, core) of one name; nulls of a null."""
    plain = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), REPLACED, squeezed(name))
    parts = let(without_fragments(plain, fragments), split_prefix)
    cleaned = let(parts, lambda p: F.struct(p["prefix"].alias("prefix"), settled(p["rest"]).alias("core")))
    return F.when(name.isNotNull(), cleaned)
