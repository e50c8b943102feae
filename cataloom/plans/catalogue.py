"""Queries over titles and catalogues: readings, slips, certainty, version order, cuts, names. The SQL writes its word lists down itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cataloom.functions import dates, files, titles
from cataloom.functions import names as single
from cataloom.operators import certainty as sure
from cataloom.operators import cubes, curves, intervals, names
from cataloom.plans.registry import query
from cataloom.session import spread, table

# --- title readings ------------------------------------------------------------------------------------------------

#: A title of some shape for each part: articles, numerals, number words, labels, subtitles, umlauts, conjunctions, possessives.
_TITLES = r"""
SELECT p_partkey, CASE p_partkey % 9
  WHEN 0 THEN 'The ' || w1 || ' and the ' || w2 || ' of ' || p_brand
  WHEN 1 THEN w1 || ' ' || w2 || ' Part ' || substr('i   ii  iii iv  v   vi  viiiix  ', 4 * (p_size % 8) + 1, 4)
  WHEN 2 THEN w1 || ' ' || p_size || ': ' || w2 || ' (19' || CAST(10 + p_size AS VARCHAR(2)) || ')'
  WHEN 3 THEN 'Movie ' || w1 || ' the Movie - ' || w2
  WHEN 4 THEN w1 || '''s ' || w2 || ', The'
  WHEN 5 THEN 'Zwölf ' || w1 || ' und Über ' || w2
  WHEN 6 THEN w1 || ' & ' || w2 || ' Vol. Two - Teil 3'
  WHEN 7 THEN 'Film a ' || w1 || ' Chapter Seven 1999 Live'
  ELSE w1 || ' I' END AS title
FROM (SELECT p_partkey, p_brand, p_size, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part)"""

_ARTICLE = "('the','a','an','le','la','les','l','un','une','des','du','de','der','die','das','den','dem','ein','eine','einer','einen','het','een','el','los','las','una','unos','unas','il','lo','gli','i','uno','o','os','as')"
_FIGURES = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "two": 2, "seven": 7, "zwolf": 12, "zwoelf": 12}
_COUNTS = "regexp_full_match({0}, '[0-9]+') AND NOT regexp_full_match({0}, '[12][0-9]{{3}}')"
_NUMBER_LABEL = "('part','parts','pt','teil','chapter','chapitre','kapitel','vol','volume','deel','parte','episode','episodio','epizoda')"
_LABEL = "('movie','film','themovie','thefilm','documentary','documentaries','thedocumentary','doku','dokumentation','docu','documentaire','documental','documentario')"
_FILLER = "('movie','movies','film','filme','films','feature','featurefilm','featurette','featurettes','special','specials','fullmovie','thefilm','themovie')"


def _longer(kept: str, least: int) -> str:
    return f"CASE WHEN len({kept}) >= {least} THEN {kept} ELSE w END"


def _numbered(at: str) -> str:
    return f"coalesce({_COUNTS.format(f'w[{at}]')} AND NOT (w[{at}] = '1' AND {at} = len(w)), false)"


_AS_FIGURES = "list_transform(w, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FIGURES.items()) + " ELSE x END)"
_NO_NUMBER_LABEL = _longer(f"list_filter(w, lambda x, i: NOT (x IN {_NUMBER_LABEL} AND (i > 1 AND {_numbered('i - 1')} OR i < len(w) AND {_numbered('i + 1')})))", 2)
_UNLABELLED = f"list_filter(w, lambda x, i: i = 1 OR x NOT IN {_LABEL})"
_STEPS = (
    "list_transform(w, lambda x, i: CASE WHEN i = 1 OR i = len(w) THEN x WHEN x IN ('and','und','et','en','y','e','ed','i','og','och','ja','a','es','si','ve','to') THEN 'and' WHEN x IN ('vs','v','versus','gegen','contre') THEN 'vs' ELSE x END)",
    f"CASE WHEN len(w) > 1 AND w[1] IN {_ARTICLE} THEN w[2:] WHEN len(w) > 1 AND w[-1] IN {_ARTICLE} THEN w[:len(w) - 1] ELSE w END",
    _longer(f"list_filter(w, lambda x: x NOT IN {_ARTICLE})", 2),
    f"w[least(len(w), coalesce(list_position(list_transform(w, lambda x: x NOT IN {_FILLER}), true), len(w))):]",
    f"CASE WHEN len({_UNLABELLED}) > 2 AND ({_UNLABELLED})[-1] = 'live' THEN ({_UNLABELLED})[:len({_UNLABELLED}) - 1] WHEN len({_UNLABELLED}) > 1 THEN {_UNLABELLED} ELSE w END",
    _longer("list_filter(w, lambda x: x <> 's')", 1),
    _AS_FIGURES,
    _NO_NUMBER_LABEL,
    "CASE WHEN len(w) > 1 AND w[-1] = '1' THEN w[:len(w) - 1] ELSE w END",
    _longer(f"list_filter(w, lambda x, i: i = 1 OR i = len(w) OR NOT ({_COUNTS.format('x')}))", 2),
)
_SPLIT = r"list_filter(regexp_split_to_array(lower(strip_accents(replace({0}, '&', ' and '))), '[^a-z0-9]+'), lambda x: x <> '')"
_READINGS = rf"""
WITH titles AS ({_TITLES}),
written AS (SELECT p_partkey, title FROM titles UNION SELECT p_partkey, replace(replace(title, 'ö', 'oe'), 'Ü', 'Ue') FROM titles),
parts AS (SELECT *, regexp_split_to_array(title, '\s[-–—]\s|:\s|\s\|\s|\s\(') AS p FROM written),
heads AS (SELECT *, {_SPLIT.format("array_to_string(p[:n], ' ')")} AS w FROM (SELECT *, unnest(range(1, len(p))) AS n FROM parts)),
figured AS (SELECT * REPLACE ({_AS_FIGURES} AS w), w AS head FROM heads),
told AS (SELECT * REPLACE ({_NO_NUMBER_LABEL} AS w) FROM figured),
cut AS (SELECT p_partkey, title, p, min_by(head, n) AS head, min(n) AS n FROM told WHERE len(w) > 1 AND {_COUNTS.format("w[-1]")} GROUP BY ALL),
f0 AS (SELECT p_partkey, {_SPLIT.format("title")} AS w FROM written
  UNION SELECT p_partkey, head || list_filter({_SPLIT.format("array_to_string(p[n + 1:], ' ')")}, lambda x: regexp_full_match(x, '[12][0-9]{{3}}')) FROM cut),
{", ".join(f"f{i} AS (SELECT p_partkey, w FROM f{i - 1} UNION SELECT p_partkey, {step} FROM f{i - 1})" for i, step in enumerate(_STEPS, 1))}
SELECT p_partkey, COUNT(*) AS n, string_agg(key, '|' ORDER BY key) AS keys
FROM (SELECT p_partkey, array_to_string(w, ' ') AS key FROM f{len(_STEPS)} UNION SELECT p_partkey, array_to_string(w, '') FROM f{len(_STEPS)}) WHERE key <> '' GROUP BY p_partkey"""


def _titled(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("cataloom_titled")
    return spark.sql(_TITLES.replace("FROM part)", "FROM cataloom_titled)").replace("'''s '", r"'\'s '").replace("VARCHAR(2)", "STRING"))


def _told_once(rows: DataFrame, of: str, **made: Column) -> DataFrame:
    """``rows`` with columns made of the column ``of``, each worked out once for a distinct value, and those dealt over many tasks.

    Joined by sorting, as what is made is far larger than the file that it is estimated by.
    """
    values = spread(rows.select(of).distinct())
    values = values.select(F.col(of).alias("__of"), *[c.alias(name) for name, c in made.items()])
    return rows.join(values.hint("merge"), F.col(of).eqNullSafe(F.col("__of")), "left").drop("__of")


@query(_READINGS)
def title_readings(spark, sf_dir):
    keys = _told_once(_titled(spark, sf_dir), "title", keys=F.array_sort(titles.readings(F.col("title"))))
    return keys.select("p_partkey", F.size("keys").cast("long").alias("n"), F.array_join("keys", "|").alias("keys"))


_ASKED = """
SELECT p_partkey, w1, w2, CASE p_partkey % 8 WHEN 0 THEN 'Movie: ' || w1 || ' ' || w2 WHEN 1 THEN w1 || ' - ' || w2 || ' II' WHEN 2 THEN w1 || ' the Movie ' || w2 WHEN 3 THEN w1 || ' fuer ' || w2 WHEN 4 THEN w1 || ' ' || w2 || ' I'
  WHEN 5 THEN w1 || ' ' || w2 || ' - Part 2' WHEN 6 THEN w1 || ' & ' || w2 || ' - Live' ELSE w1 || ' ' || w2 || ' (a.k.a. ' || w2 || ' ' || w1 || ')' END AS title
FROM (SELECT p_partkey, replace(split_part(p_name, ' ', 1), 'ue', 'u') AS w1, replace(split_part(p_name, ' ', 2), 'ue', 'u') AS w2 FROM part)"""


@query(f"""
SELECT p_partkey, title || CASE p_partkey % 8 WHEN 0 THEN '|' || w1 || ' ' || w2 WHEN 1 THEN '|' || w2 || ' II|' || w1 || ' - ' || w2 || ' 2' WHEN 2 THEN '|' || w1 || ' ' || w2 WHEN 3 THEN '|' || w1 || ' für ' || w2 WHEN 4 THEN '|' || w1 || ' ' || w2 || ' 1|' || w1 || ' ' || w2
  WHEN 6 THEN '|Live|' || w1 || ' & ' || w2 ELSE '' END AS asked, CASE p_partkey % 8 WHEN 7 THEN w1 || ' ' || w2 || '|' || w2 || ' ' || w1 ELSE '' END AS together
FROM ({_ASKED})""")
def search_spellings(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("cataloom_asked")
    rows = spark.sql(_ASKED.replace("FROM part)", "FROM cataloom_asked)"))
    asked, together = titles.search_spellings(F.col("title")), titles.titles_together(F.col("title"))
    told = _told_once(rows.select("p_partkey", "title"), "title", asked=F.array_join(asked, "|"), together=F.array_join(together, "|"))
    return told.select("p_partkey", "asked", "together")


# --- slips ---------------------------------------------------------------------------------------------------------

#: Names and what a hand, or something else, made of them: one or two changes at some place.
_HANDS = """
SELECT p_partkey, CASE WHEN p_partkey % 15 = 12 THEN substr(a, 1, 5) ELSE a END AS a, CASE p_partkey % 15
  WHEN 0 THEN substr(a, 1, k - 1) || 'q' || substr(a, k + 1)
  WHEN 1 THEN substr(a, 1, k - 1) || substr(a, k + 1)
  WHEN 2 THEN substr(a, 1, k - 1) || 'q' || substr(a, k)
  WHEN 3 THEN substr(a, 1, k - 1) || substr(a, k + 1, 1) || substr(a, k, 1) || substr(a, k + 2)
  WHEN 4 THEN substr(a, 1, k - 1) || ' ' || substr(a, k)
  WHEN 5 THEN substr(a, 1, s - 1) || substr(a, s + 1)
  WHEN 6 THEN substr(a, 1, k - 1) || '7' || substr(a, k + 1)
  WHEN 7 THEN 'q' || substr(a, 2, k) || 'z' || substr(a, k + 3)
  WHEN 8 THEN substr(a, 1, s - 1) || substr(a, s + 1, 1) || ' ' || substr(a, s + 2)
  WHEN 9 THEN substr(a, 1, k - 1) || '7' || substr(a, k)
  WHEN 10 THEN substr(a, 1, k - 1) || ' ' || substr(a, k + 1)
  WHEN 11 THEN a
  WHEN 12 THEN substr(a, 1, 4) || 'q'
  WHEN 13 THEN substr(a, 1, k - 1) || substr(a, k + 2, 1) || substr(a, k + 1, 1) || substr(a, k, 1) || substr(a, k + 3)
  ELSE substr(a, 1, length(a) - 1) END AS b
FROM (SELECT p_partkey, a, CAST(1 + (p_partkey * 7) % length(a) AS INT) AS k, CAST(strpos(a, ' ') AS INT) AS s FROM
  (SELECT p_partkey, lower(p_name) || ' ' || CAST(p_partkey % 7 AS VARCHAR(9)) || ' ' || CAST(10 + p_partkey % 80 AS VARCHAR(9)) AS a FROM part))"""
_AT = "range(1, length(a) + 1)"


def _letter(text: str, at: str) -> str:
    return f"regexp_full_match(substr({text}, {at}, 1), '[a-z]')"


def _surplus(long: str, short: str) -> str:
    digit = "regexp_full_match(substr({0}, i {1} 1, 1), '[0-9]')"
    counts = digit.format(long, "-") + " AND i > 1 AND " + digit.format(long, "+")
    return f"len(list_filter(range(1, length({long}) + 1), lambda i: substr({long}, 1, i - 1) || substr({long}, i + 1) = {short} AND ({_letter(long, 'i')} OR substr({long}, i, 1) = ' ' AND NOT ({counts})))) > 0"


#: Every place is tried for every change that is allowed.
_SLIPS = f"""
SELECT p_partkey, a, b, a <> b AND length(a) >= 6 AND length(b) >= 6 AND (
  len(list_filter({_AT}, lambda i: substr(a, 1, i - 1) = substr(b, 1, i - 1) AND substr(a, i + 1) = substr(b, i + 1) AND {_letter("a", "i")} AND {_letter("b", "i")})) > 0
  OR len(list_filter({_AT}, lambda i: substr(a, 1, i - 1) || substr(a, i + 1, 1) || substr(a, i, 1) || substr(a, i + 2) = b AND i < length(a) AND ({_letter("a", "i")} OR substr(a, i, 1) = ' ')
    AND ({_letter("a", "i + 1")} OR substr(a, i + 1, 1) = ' '))) > 0
  OR {_surplus("a", "b")} OR {_surplus("b", "a")}) AS slip
FROM ({_HANDS})"""


@query(_SLIPS)
def one_slip(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("cataloom_slips")
    pairs = spark.sql(_HANDS.replace("FROM part))", "FROM cataloom_slips))").replace("strpos(a, ' ')", "instr(a, ' ')").replace("VARCHAR(9)", "STRING"))
    return pairs.select("p_partkey", "a", "b", titles.one_slip(F.col("a"), F.col("b")).alias("slip"))


# --- certainty -----------------------------------------------------------------------------------------------------

#: Offers with one or two release years or none, stated minutes that are sometimes missing or 0, and other names; blocks of parts keep titles apart.
_OFFERS = """
SELECT p_partkey AS offer, brand, kind, CASE WHEN p_size % 11 = 0 THEN NULL ELSE 1980 + p_size % 7 END AS y1, CASE WHEN p_size % 11 = 0 THEN NULL ELSE 1980 + p_partkey % 9 END AS y2,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN 0 ELSE 80 + p_size END AS minutes, p_partkey % 5 <> 0 AS catalogued, p_size % 3 AS names
FROM (SELECT *, lower(p_brand) || ' ' || CAST(FLOOR(p_partkey / 60) AS INT) AS brand, lower(p_type) || ' ' || CAST(FLOOR(p_partkey / 30) AS INT) AS kind FROM part)"""
_WANTED = """
SELECT p_partkey AS id, brand, kind, CASE WHEN p_size % 10 = 0 THEN NULL ELSE 1980 + p_partkey % 9 + CASE WHEN p_size % 4 = 0 THEN 2 WHEN p_size % 17 = 0 THEN 30 ELSE 0 END END AS year,
  CASE WHEN p_size % 19 = 0 THEN NULL ELSE (80 + p_size) * 60.0 + p_partkey % 700 END AS seconds, CASE WHEN p_partkey % 21 = 0 THEN 1984 END AS written, p_size % 2 AS plainly
FROM (SELECT *, lower(p_brand) || ' ' || CAST(FLOOR(p_partkey / 60) AS INT) AS brand, lower(p_type) || ' ' || CAST(FLOOR(p_partkey / 30) AS INT) AS kind FROM part)"""


def _left(name: str, of: str, test: str) -> str:
    """Of the rows of ``of`` those that pass, or all of an id of which none does."""
    return f"{name} AS (SELECT * FROM {of} WHERE ({test}) OR id NOT IN (SELECT id FROM {of} WHERE {test}))"


#: Set aside step by step, each step over the rows that the last one left.
_CERTAIN = f"""
WITH offers AS ({_OFFERS}), wanted AS ({_WANTED}),
met AS (SELECT id, offer, year, seconds, minutes, y1, y2, catalogued, least(y1, y2) AS first,
    CASE WHEN seconds > 0 AND minutes > 0 THEN abs(seconds - minutes * 60) <= greatest(300, minutes * 60 * 0.07) END AS agrees,
    CASE plainly WHEN 0 THEN w.brand = o.brand ELSE names = 1 AND w.kind = o.kind END AS leads,
    CASE plainly WHEN 0 THEN w.brand = o.brand ELSE names >= 1 AND w.kind = o.kind END AS own, CASE plainly WHEN 0 THEN w.brand = o.brand ELSE w.kind = o.kind END AS spelled
  FROM wanted w JOIN offers o ON (w.brand = o.brand OR w.kind = o.kind) WHERE written IS NULL OR y1 IS NULL OR least(y1, y2) <= written),
{_left("a", "met", "catalogued")}, {_left("b", "a", "leads")}, {_left("c", "b", "own")}, {_left("d", "c", "spelled")},
{_left("e", "d", "year IN (y1, y2)")}, dated AS (SELECT * FROM e WHERE year IN (y1, y2)), {_left("f", "dated", "abs(first - year) <= 1")},
only_year AS (SELECT id, min(offer) AS pick, 'year' AS how FROM f GROUP BY id HAVING count(*) = 1),
beside AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM dated) AND (abs(y1 - year) <= 1 OR abs(y2 - year) <= 1)),
around AS (SELECT * FROM e WHERE id NOT IN (SELECT id FROM dated) AND id NOT IN (SELECT id FROM beside) AND (abs(y1 - year) <= 3 OR abs(y2 - year) <= 3)),
measured AS (SELECT id, offer, agrees, y1 FROM f WHERE id NOT IN (SELECT id FROM only_year) UNION ALL SELECT id, offer, agrees, y1 FROM beside
  UNION ALL SELECT id, offer, agrees, y1 FROM around UNION ALL SELECT id, offer, agrees, y1 FROM d WHERE year IS NULL),
by_length AS (SELECT id, min(offer) FILTER (agrees) AS pick, 'length' AS how FROM measured GROUP BY id
  HAVING count(*) FILTER (agrees) = 1 AND count(*) FILTER (agrees IS NULL) = 0 AND count(*) FILTER (agrees AND y1 IS NOT NULL) = 1)
SELECT w.id, pick, how FROM wanted w LEFT JOIN (SELECT * FROM only_year UNION ALL SELECT * FROM by_length) USING (id)"""


@query(_CERTAIN)
def certainty(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("cataloom_offers")
    both = [spark.sql(q.replace("FROM part)", "FROM cataloom_offers)")) for q in (_OFFERS, _WANTED)]
    names, some = F.array("brand", "kind"), lambda test: F.when(test, F.array("brand", "kind")).otherwise(F.array("brand"))
    lead = F.when(F.col("names") == 1, names).otherwise(F.array("brand"))
    offers = both[0].select("offer", names.alias("keys"), lead.alias("lead"), some(F.col("names") >= 1).alias("own"), names.alias("spelled"), F.array_compact(F.array("y1", "y2")).alias("years"), "minutes", "catalogued")
    wanted = both[1].select("id", names.alias("keys"), F.when(F.col("plainly") == 0, F.array("brand")).otherwise(F.array("kind")).alias("plain"), "year", "seconds", "written")
    return sure.certain(wanted, offers)


# --- version order -------------------------------------------------------------------------------------------------

_VERSIONED = """
SELECT p_partkey, p_brand, dot || mark || '-' || number || ending AS name, dot, mark, CAST(number AS INT) AS n FROM (SELECT p_partkey, p_brand,
  CASE WHEN p_partkey % 11 = 0 THEN '.' ELSE '' END AS dot, CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a~' WHEN 2 THEN 'ab' ELSE 'a_' END AS mark,
  CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR(9)) WHEN 1 THEN '0' || CAST(p_size AS VARCHAR(9)) ELSE CAST(1000 + p_partkey AS VARCHAR(9)) END AS number,
  CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN '.mp3' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '~' ELSE '.old~' END AS ending FROM part)"""


@query(f"""SELECT p_partkey, name, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY CASE dot WHEN '.' THEN 0 ELSE 1 END,
  CASE mark WHEN 'a~' THEN 1 WHEN 'ab' THEN 2 WHEN 'a' THEN 3 ELSE 4 END, n, CASE WHEN name LIKE '%~' AND name NOT LIKE '%.old~' THEN 0 ELSE 1 END, substr(name, 1 + length(dot)), p_partkey) AS place FROM ({_VERSIONED})""")
def version_order(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("cataloom_versions")
    names = spark.sql(_VERSIONED.replace("FROM part)", "FROM cataloom_versions)").replace("VARCHAR(9)", "STRING"))
    order = Window.partitionBy("p_brand").orderBy(titles.version_key(F.col("name")), "p_partkey")
    return names.select("p_partkey", "name", F.row_number().over(order).cast("long").alias("place"))


# --- cuts that depend on each other --------------------------------------------------------------------------------


@query("""
WITH RECURSIVE m AS (SELECT user_id, epoch(ts) - epoch(TIMESTAMP '2024-01-01') AS mid FROM events),
g AS (SELECT user_id, 2600000.0 AS total, CAST(user_id % 29 AS BIGINT) AS pieces FROM events GROUP BY user_id),
walk AS (SELECT user_id, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS last, NULL::DOUBLE AS cut FROM g WHERE pieces >= 2
  UNION ALL SELECT user_id, k, CASE WHEN best <= last + 1 THEN last ELSE best END, CASE WHEN best <= last + 1 THEN NULL ELSE best END
  FROM (SELECT w.user_id, w.k + 1 AS k, w.last, coalesce(min_by(m.mid, {'d': abs(m.mid - (w.k + 1) * (total / pieces)), 'm': m.mid}), any_value((w.k + 1) * (total / pieces))) AS best
    FROM walk w JOIN g ON g.user_id = w.user_id AND w.k + 1 < pieces LEFT JOIN m ON m.user_id = w.user_id AND abs(m.mid - (w.k + 1) * (total / pieces)) <= total / pieces / 2
      AND m.mid > w.last + total / pieces * 0.2 AND m.mid < total - total / pieces * 0.2 GROUP BY w.user_id, w.k, w.last))
SELECT user_id, k AS piece, cut FROM walk WHERE cut IS NOT NULL""")
def sequential_cuts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200).alias("mid"))
    wholes = events.groupBy("user_id").agg(F.lit(2_600_000.0).alias("total"), (F.col("user_id") % 29).alias("pieces"))
    return intervals.sequential_cuts(events, wholes, ["user_id"], "mid", "total", "pieces")


# --- correlation ---------------------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS h, list_transform(embedding[1 + vec_id % 17 : 16 + vec_id % 17], lambda x: 3.0::DOUBLE * x::DOUBLE + 0.02::DOUBLE) AS n FROM embeddings),
l AS (SELECT vec_id, h, n, unnest(range(0, len(h) - len(n) + 1)) AS lag FROM v),
s AS (SELECT vec_id, lag, list_inner_product(h[lag + 1 : lag + len(n)], n) / (sqrt(list_inner_product(h[lag + 1 : lag + len(n)], h[lag + 1 : lag + len(n)])) * sqrt(list_inner_product(n, n))) AS score FROM l)
SELECT vec_id, max_by(lag, score) AS lag, ROUND(MAX(score), 6) AS score FROM s GROUP BY vec_id""")
def best_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("h"))
    needle = F.transform(F.slice("h", (1 + F.col("vec_id") % 17).cast("int"), 16), lambda x: x * 3.0 + 0.02)
    found = rows.select("vec_id", curves.best_lag(needle, F.col("h")).alias("f"))
    return found.select("vec_id", "f.lag", F.round("f.score", 6).alias("score"))


# --- names of siblings ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey, lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ' ' || p_type AS clean FROM part")
def sibling_names(spark, sf_dir):
    """Three groups of a third of the rows each: a shared front, a shared back with its brackets, and a shared middle go."""
    rows = table(spark, sf_dir, "part")
    number, group = F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.col("p_size") % 3
    name = F.concat(F.lit("Vol "), group.cast("string"), F.lit(" - "), number, F.lit(" and the Same words "), "p_type", F.lit(" [x265]"))
    named = rows.select("p_partkey", group.alias("folder"), F.when(F.col("p_partkey") % 2 == 0, F.replace(name, F.lit("Same"), F.lit("same"))).otherwise(name).alias("name"))
    return names.clean_siblings(named, ["folder"], "name").select("p_partkey", "clean")


#: Names as tools write them, with what is left of each.
_WRITTEN = """
SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN n || ' - ' || p_name WHEN 1 THEN '2024-01-15 ' || p_name || '.' || n WHEN 2 THEN '( ' || n || ') ' || p_name || ' -' WHEN 3 THEN n || ' -' || p_name
    WHEN 4 THEN p_name || ' (1 ' || n || ')' WHEN 5 THEN p_name || ' (9 1)' WHEN 6 THEN '_' || p_name || '_#' || n WHEN 7 THEN n || '-' || n || ' ' || p_name WHEN 8 THEN n || '--' || p_name || '...' WHEN 9 THEN p_name || ' FREE copy' || n
    WHEN 10 THEN 'a' || n || 'z ' || p_name ELSE p_name || ' free web-rip free' END AS name, p_name, n
FROM (SELECT p_partkey, p_name, CAST(10 + p_partkey % 90 AS VARCHAR(9)) AS n FROM part)"""


@query(f"""
SELECT p_partkey, name, CASE p_partkey % 12 WHEN 0 THEN n WHEN 1 THEN '2024-01-15' WHEN 2 THEN n WHEN 3 THEN n WHEN 7 THEN n || '-' || n WHEN 8 THEN n ELSE '' END AS prefix,
  CASE p_partkey % 12 WHEN 1 THEN p_name || ' ' || n WHEN 4 THEN p_name || ' (1-' || n || ')' WHEN 5 THEN p_name || ' (9 1)' WHEN 6 THEN p_name || ' Ep.' || n WHEN 9 THEN p_name || ' copy' || n WHEN 10 THEN 'a' || n || 'z ' || p_name ELSE p_name END AS core
FROM ({_WRITTEN})""")
def single_names(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("cataloom_written")
    rows = spark.sql(_WRITTEN.replace("FROM part)", "FROM cataloom_written)").replace("VARCHAR(9)", "STRING"))
    cleaned = rows.select("p_partkey", "name", single.clean_name(F.col("name"), ["free", "WEB-rip", "opy"]).alias("c"))
    return cleaned.select("p_partkey", "name", "c.prefix", "c.core")


_PREFIXED = """
SELECT p_partkey, CAST(FLOOR(p_partkey / 8) AS BIGINT) AS folder, CASE k WHEN 0 THEN CAST(n + 95 AS VARCHAR(9)) WHEN 1 THEN '2024' WHEN 2 THEN '2024-01-15' WHEN 3 THEN CAST(n AS VARCHAR(9)) WHEN 4 THEN CAST(2 * n AS VARCHAR(9)) WHEN 5 THEN '00' || CAST(n AS VARCHAR(9)) ELSE '7' END AS prefix,
  CASE k WHEN 0 THEN CASE n WHEN 3 THEN '98' ELSE p_name END WHEN 3 THEN '0' || CAST(n AS VARCHAR(9)) || ' ' || p_name WHEN 6 THEN CASE n WHEN 5 THEN '' ELSE p_name END ELSE p_name END AS core
FROM (SELECT p_partkey, p_name, p_partkey % 8 + 1 AS n, CAST(FLOOR(p_partkey / 8) AS BIGINT) % 7 AS k FROM part)"""


@query(f"""
WITH r AS ({_PREFIXED}),
d AS (SELECT *, min(CASE WHEN prefix <> '' AND (CASE WHEN regexp_full_match(prefix, '[0-9]+') AND regexp_full_match(split_part(core, ' ', 1), '[0-9]+') THEN prefix::HUGEINT = split_part(core, ' ', 1)::HUGEINT ELSE core = prefix OR starts_with(core, prefix || ' ') END) THEN 1 ELSE 0 END) OVER (PARTITION BY folder) AS again FROM r),
e AS (SELECT p_partkey, folder, core, CASE again WHEN 1 THEN '' ELSE prefix END AS prefix FROM d),
f AS (SELECT *, min(CASE WHEN regexp_full_match(prefix, '[0-9]+') THEN 1 ELSE 0 END) OVER w AS numbers, max(TRY_CAST(prefix AS HUGEINT)) OVER w AS most, min(TRY_CAST(prefix AS HUGEINT)) OVER w AS least, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY folder)),
g AS (SELECT *, numbers = 1 AND n > 1 AND most - least + 1 = n AND n = (SELECT count(DISTINCT TRY_CAST(x.prefix AS HUGEINT)) FROM e x WHERE x.folder = f.folder) AS run FROM f),
h AS (SELECT p_partkey, folder, CASE WHEN run THEN lpad(CAST(prefix::HUGEINT AS VARCHAR), length(CAST(most AS VARCHAR))::INT, '0') ELSE prefix END AS prefix,
  CASE WHEN run AND core = prefix THEN lpad(CAST(prefix::HUGEINT AS VARCHAR), length(CAST(most AS VARCHAR))::INT, '0') ELSE core END AS core FROM g),
u AS (SELECT *, min(prefix) OVER w = max(prefix) OVER w AND min(prefix) OVER w <> '' AND count(*) OVER w > 1 AND min(length(core)) OVER w > 0 AND NOT regexp_full_match(prefix, '[12][0-9]{{3}}([0-9]{{4}}|-[01][0-9]-[0-3][0-9])') AS same FROM h WINDOW w AS (PARTITION BY folder))
SELECT p_partkey, CASE WHEN same THEN '' ELSE prefix END AS prefix, core FROM u""")
def group_prefixes(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("cataloom_prefixed")
    rows = spark.sql(_PREFIXED.replace("FROM part)", "FROM cataloom_prefixed)").replace("VARCHAR(9)", "STRING"))
    return names.settled_prefixes(rows, ["folder"], "prefix", "core").select("p_partkey", "prefix", "core")


# --- dates and times -----------------------------------------------------------------------------------------------

_SPECS = """
SELECT event_id, ts, CASE event_id % 9 WHEN 0 THEN 'today-' || n || 'weeks..now+' || k || 'days' WHEN 1 THEN '2024' || lpad(CAST(1 + event_id % 13 AS VARCHAR(9)), 2, '0') || '15..'
  WHEN 2 THEN '..yesterday' WHEN 3 THEN '-' || n || 'months..today' WHEN 4 THEN 'now-' || n || 'hours' WHEN 5 THEN 'today+' || n || 'minute..+' || k || 'years' WHEN 6 THEN 'tomorrow..today'
  WHEN 7 THEN '' ELSE 'today..2024..' END AS spec, n, k FROM (SELECT event_id, ts, CAST(user_id % 40 AS VARCHAR(9)) AS n, CAST(event_id % 17 AS VARCHAR(9)) AS k FROM events)"""


@query(f"""
SELECT event_id, spec, event_id % 9 NOT IN (6, 8) AS valid, CAST(CASE event_id % 9 WHEN 0 THEN date_trunc('day', ts) - CAST(n AS INT) * INTERVAL 7 DAY
    WHEN 1 THEN CASE WHEN 1 + event_id % 13 <= 12 THEN make_date(2024, 1 + event_id % 13, 15) END WHEN 3 THEN date_trunc('day', ts) - CAST(n AS INT) * INTERVAL 1 MONTH WHEN 4 THEN ts - CAST(n AS INT) * INTERVAL 1 HOUR
    WHEN 5 THEN date_trunc('day', ts) + CAST(n AS INT) * INTERVAL 1 MINUTE END AS DATE) AS after,
  CAST(CASE event_id % 9 WHEN 0 THEN ts + CAST(k AS INT) * INTERVAL 1 DAY WHEN 2 THEN date_trunc('day', ts) - INTERVAL 1 DAY WHEN 3 THEN ts WHEN 5 THEN date_trunc('day', ts) + CAST(k AS INT) * INTERVAL 1 YEAR END AS DATE) AS before
FROM ({_SPECS})""")
def date_ranges(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("cataloom_specs")
    rows = spark.sql(_SPECS.replace("FROM events)", "FROM cataloom_specs)").replace("VARCHAR(9)", "STRING"))
    return rows.select("event_id", "spec", dates.date_range(F.col("spec"), F.col("ts").cast("timestamp")).alias("r")).select("event_id", "spec", "r.valid", "r.after", "r.before")


_CLOCKS = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN h || ':' || m || ':' || s WHEN 1 THEN ' ' || h || ':' || m || '.5 ' WHEN 2 THEN s WHEN 3 THEN h || '.' || m WHEN 4 THEN h || ':' || m || ':' || s || ',25'
  WHEN 5 THEN '-' || s ELSE h || 'h' || m END AS text, h, m, s
FROM (SELECT event_id, CAST(user_id AS VARCHAR(9)) AS h, CAST(event_id % 75 AS VARCHAR(9)) AS m, CAST(event_id % 67 AS VARCHAR(9)) AS s FROM events)"""


@query(f"""
SELECT event_id, text, CAST(CASE event_id % 7 WHEN 0 THEN CASE WHEN greatest(m::INT, s::INT) < 60 THEN 1000 * (3600 * h::INT + 60 * m::INT + s::INT) END WHEN 1 THEN CASE WHEN m::INT < 60 THEN 60000 * h::INT + 1000 * m::INT + 500 END
  WHEN 2 THEN 1000 * s::INT WHEN 3 THEN round(1000 * CAST(h || '.' || m AS DECIMAL(18, 6))) WHEN 4 THEN CASE WHEN greatest(m::INT, s::INT) < 60 THEN 1000 * (3600 * h::INT + 60 * m::INT + s::INT) + 250 END END AS BIGINT) AS ms
FROM ({_CLOCKS})""")
def timestamps(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("cataloom_clocks")
    rows = spark.sql(_CLOCKS.replace("FROM events)", "FROM cataloom_clocks)").replace("VARCHAR(9)", "STRING"))
    return rows.select("event_id", "text", dates.timestamp_ms(F.col("text")).alias("ms"))


@query("""
SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN 'bot' WHEN 1 THEN 'challenge' WHEN 2 THEN 'challenge without help' END AS why FROM conversations WHERE text IS NOT NULL""")
def refusal_lines(spark, sf_dir):
    """Lines of a download tool around the texts of conversations."""
    rows = table(spark, sf_dir, "conversations").where("text is not null")
    kind = (F.col("conv_id") + F.col("turn")) % 4
    said = F.when(kind == 0, "ERROR: Sign in to confirm you are Not a Bot").when(kind == 1, "403, Cloudflare anti-bot challenge: --extractor-args generic:impersonate")
    said = said.when(kind == 2, "Cloudflare anti-bot challenge, impersonation dependency missing, then generic:impersonate").otherwise("sign in to confirm your age; cloudflare")
    return rows.select("conv_id", "turn", files.refusal(F.concat(said, F.lit(" "), "text")).alias("why"))


# --- grains for a viewer -------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, COUNT(*) AS files, SUM(l_partkey * 1000) / 1e9 AS \"sizeGigabytes\", SUM(CAST(l_quantity AS BIGINT) * 60) / 3600 AS \"durationHours\", CAST(SUM(l_linenumber) AS BIGINT) AS chapters FROM lineitem GROUP BY ALL")
def viewer_grain(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_partkey") * 1000).alias("sizeBytes"), (F.col("l_quantity").cast("bigint") * 60).alias("durationSeconds"), F.col("l_linenumber").alias("chapters"))
    return cubes.viewer_grain(facts, "audio", ["l_returnflag", "l_linestatus"])
