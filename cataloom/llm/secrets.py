"""Secret scan with DataFrame functions only: patterns for known kinds, and entropy of unknown candidates.

Known kinds are found by regular expressions, leftmost and non-overlapping per kind. Their places come from
splitting the text by the same expression: pieces and matches alternate, so lengths add up to offsets.

Unknown secrets: candidates are whole runs of 20 or more letters, digits and ``+/_=-``. A window of ``WINDOW``
characters slides over a candidate; the counts of its characters change by one in and one out, and with them
the sum of c log2 c, so each step costs a constant. A window whose Shannon entropy reaches the threshold of
the candidate's character class (hexadecimal, or mixed letters and digits) is hot. A candidate with a hot window is
reported as kind entropy, unless the allow-list knows it (words without digits, runs of one letter case with
separators, UUIDs, file paths, dates) or it overlaps a known kind.

Defined results: null text is empty; rows without doc_id and repeated rows are scanned like others.
Offsets count code points from 0, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")
SHORTEST_ASSIGN, SHORTEST_ACCESS, SHORTEST_HEX = 6, 20, 24

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Least entropy in bits of a hot window; 20 characters can reach 4 for hexadecimal and 4.32 otherwise.
HEX_ENTROPY, MIXED_ENTROPY = 3.05, 3.75
#: Candidates that are no secrets: without a digit; without a letter; UUIDs; dates and times.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
)
#: Nor are words of two letters or more and numbers of up to four digits that separators join: such a candidate has two
#: parts and no place that breaks the rule. Two plain searches, as a repeated group would use the stack up on long paths.
JOINED = r"[A-Za-z0-9][/_=-]+[A-Za-z0-9]"
NOT_JOINED = r"\+|[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}|(?<![A-Za-z0-9])[A-Za-z](?![A-Za-z0-9])|^[_=-]|^/[/_=-]"


def _places(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, end, kind, match) of all matches of ``pattern``."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,match:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        found = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.array_append(state["out"], found).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    whole = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]
    return F.when(F.size(matches) == 0, empty).otherwise(whole)


def _hot(candidate: Column, least: Column) -> Column:
    """Whether a window of the candidate has an entropy of at least ``least``, by incremental counts over its characters."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    before = F.slice(F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), codes), 1, F.length(candidate))
    moves = F.zip_with(F.slice(codes, 1, F.length(candidate)), before, lambda came, went: F.struct(came.alias("came"), went.alias("went")))
    term = lambda n: F.when(n > 1, n * F.log2(F.when(n > 1, n).otherwise(2))).otherwise(0.0)
    start = F.struct(F.lit(0).alias("n"), F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("best"))

    def change(counts: Column, code: Column, by: int) -> Column:
        new = F.get(counts, code) + by
        return F.concat(F.slice(counts, 1, code), F.array(new), F.slice(counts, code + 2, 127 - code))

    def step(state: Column, move: Column) -> Column:
        came, went, n = move["came"], move["went"], state["n"] + 1
        more = term(F.get(state["counts"], came) + 1) - term(F.get(state["counts"], came))
        grown = F.struct(change(state["counts"], came, 1).alias("counts"), (state["sum"] + more).alias("sum"))
        less = term(F.get(grown["counts"], went)) - term(F.get(grown["counts"], went) - 1)
        counts = F.when(went.isNotNull(), change(grown["counts"], went, -1)).otherwise(grown["counts"])
        total = F.when(went.isNotNull(), grown["sum"] - less).otherwise(grown["sum"])
        best = F.when(n >= WINDOW, F.least(state["best"], total)).otherwise(state["best"])
        return F.struct(n.alias("n"), counts.alias("counts"), total.alias("sum"), best.alias("best"))

    least_sum = F.aggregate(moves, start, step)["best"]
    return F.lit(math.log2(WINDOW)) - least_sum / WINDOW >= least


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    assign = F.filter(_places(F.col("text"), ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= SHORTEST_ASSIGN)
    access = F.filter(_places(F.col("text"), ACCESS, 1), lambda x: F.length(x["match"]) >= SHORTEST_ACCESS)
    # a run of hexadecimal digits that is long enough is the same match with or without its shorter brothers
    hexes = _places(F.col("text"), rf"(?<![0-9a-f])[0-9a-f]{{{SHORTEST_HEX},}}+", 2)
    allowed = "|".join(f"(?:{p})" for p in ALLOWED)
    some = _places(F.col("text"), CANDIDATE, 3)
    some = F.filter(some, lambda x: ~x["match"].rlike(allowed) & ~(x["match"].rlike(JOINED) & ~x["match"].rlike(NOT_JOINED)))
    rows = rows.select("doc_id", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), some.alias("some"))
    known = F.concat("assign", "access", "hex")
    free = F.filter("some", lambda x: ~F.exists(known, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])))
    rows = rows.select("*", free.alias("free"))
    least = lambda m: F.when(m.rlike("^[0-9a-fA-F]+$"), HEX_ENTROPY).otherwise(MIXED_ENTROPY)
    rows = rows.withColumn("entropy", F.when(F.size("free") == 0, F.col("free")).otherwise(F.filter("free", lambda x: _hot(x["match"], least(x["match"])))))
    base, every = F.array_sort(_bare(F.concat("assign", "access", "hex"))), F.array_sort(_bare(F.concat("assign", "access", "hex", "entropy")))
    return rows.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
