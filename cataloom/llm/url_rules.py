"""URL filter: listed rules first, and for the rest rules mined from labelled pages by FP-growth.

Listed rules name a host with all its subdomains and the beginning of a path; the longest that fits decides.

Mined rules say that URLs with some combination of tokens (host labels and their parts, path segments, query keys, scheme) tend to
one label. Spark's FP-growth finds the frequent combinations of tokens and label; the rest is joins:

* Tokens that stand on exactly the same labelled pages are one item to FP-growth, since k of them would make 2^k combinations that
  say the same. A rule names all tokens of its items.
* A rule needs ``MIN_SUPPORT`` of the labelled pages (``MIN_PAGES`` at least) with its tokens and label, a confidence of ``MIN_CONFIDENCE`` that is also above
  the label's own rate, and no shorter rule as good: leaving out any one item must lower the confidence.
* Matching goes by an inverted index: a rule is posted under its rarest token only, a URL asks for each of its tokens, and what it gets
  is tested for the rule's other tokens. Of the rules that hold, the most confident decides, then the one with more pages, fewer
  tokens, and the least text; a URL without any is allowed.

All of it is DataFrame functions. The index is read from a table with its real size, so Spark broadcasts it only below its threshold
and joins by token beyond, splitting hot tokens; a URL that very many pages share is judged once.

Defined results: a null URL or one without ``://`` has an empty host and path, no tokens and no rule, and is allowed; rows without page_id and
repeated rows are judged like others; null labels count as no label; without labelled pages there are no mined rules.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cataloom.llm.scratch import Scratch, cut

#: Fixed values of the contract: verdict and rule, as host and path.
LISTED = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Least share of the labelled pages, least number of them, and least confidence of a mined rule.
MIN_SUPPORT, MIN_PAGES, MIN_CONFIDENCE = 0.002, 8, 0.5

_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LABEL = "="


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def host(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = LISTED) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, begin = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + begin))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL with a host: digits count as one sign, so that numbers of pages do not tell URLs apart."""
    named = host(url) != ""
    split = lambda text, by: F.filter(F.split(text, by), lambda t: t != "")
    mark = lambda kind, parts: F.transform(parts, lambda t: F.concat(F.lit(kind), F.regexp_replace(_lower(t), "[0-9]+", "#")))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(split(query, "&"), lambda pair: F.substring_index(pair, "=", 1))
    parts = [mark("h:", split(host(url), r"[.-]")), mark("p:", split(path(url), "/")), mark("q:", keys), mark("s:", F.array(F.substring_index(url, "://", 1)))]
    return F.when(named, F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, scratch: Scratch, min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(token, needed, label, confidence, hits): the inverted index of the rules mined from ``labelled`` (url, label)."""
    pages = labelled.where("label IS NOT NULL").select(tokens(F.col("url")).alias("tokens"), F.concat(F.lit(_LABEL), F.col("label")).alias("label"))
    pages = scratch.cut(pages.where(F.size("tokens") > 0).withColumn("page", F.monotonically_increasing_id()))
    n = pages.count()
    if not n:
        empty = "token string, needed array<string>, label string, confidence double, hits bigint"
        return labelled.sparkSession.createDataFrame([], empty)
    # tokens on the same pages are one item
    each = pages.select("page", F.explode("tokens").alias("token"))
    least = math.ceil(max(min_support * n, min_pages))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("page")).alias("where")).where(F.col("n") >= least)
    items = scratch.cut(seen.groupBy("n", "where").agg(F.sort_array(F.collect_list("token")).alias("needed")).withColumn("item", F.col("needed")[0]))
    held = each.join(items.select(F.col("item").alias("token")), "token").groupBy("page").agg(F.collect_list("token").alias("held"))
    baskets = pages.select("page", "label").join(held, "page", "left")
    baskets = baskets.select(F.concat(F.array("label"), F.coalesce("held", F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(baskets)
    found = scratch.cut(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    is_label = lambda t: F.startswith(t, F.lit(_LABEL))
    with_label = found.where(F.exists("items", is_label)).select(
        F.filter("items", is_label)[0].alias("label"), F.filter("items", lambda t: ~is_label(t)).alias("antecedent"), F.col("freq").alias("hits")
    )
    without = found.where(~F.exists("items", is_label)).select(F.col("items").alias("antecedent"), F.col("freq").alias("seen"))
    rates = with_label.join(without, "antecedent", "left").withColumn("seen", F.when(F.size("antecedent") == 0, n).otherwise(F.col("seen")))
    rates = scratch.cut(rates.select("label", "antecedent", "hits", (F.col("hits") / F.col("seen")).alias("confidence")))
    rate = rates.where(F.size("antecedent") == 0).select("label", F.col("confidence").alias("rate"))  # a row a label
    rules = rates.join(rate, "label").where((F.size("antecedent") > 0) & (F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("rate"))).drop("rate")
    shorter = rules.select("label", "antecedent", "confidence", F.explode("antecedent").alias("out")).select(
        "label", F.col("antecedent").alias("whole"), F.col("confidence").alias("whole_confidence"), F.array_remove("antecedent", F.col("out")).alias("antecedent")
    )
    beaten = shorter.join(rates, ["label", "antecedent"]).where(F.col("confidence") >= F.col("whole_confidence"))
    rules = rules.join(beaten.select("label", F.col("whole").alias("antecedent")).distinct(), ["label", "antecedent"], "left_anti")
    one = rules.withColumn("item", F.explode("antecedent")).join(items.select("item", "needed", "n"), "item")
    posted = one.groupBy("label", "antecedent", "confidence", "hits").agg(F.min_by("item", F.struct("n", "item")).alias("token"), F.array_sort(F.flatten(F.collect_list("needed"))).alias("needed"))
    return scratch.cut(posted.select("token", "needed", F.expr("substr(label, 2)").alias("label"), "confidence", "hits"))


def learned(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, label, confidence, mined): of each URL that some mined rule fits, what the first of those rules says."""
    asked = urls.where("url IS NOT NULL").select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    met = asked.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    met = met.where(F.forall("needed", lambda t: F.array_contains(F.col("tokens"), t)))
    text = F.array_join("needed", " ")
    order = F.struct(-F.col("confidence"), -F.col("hits"), F.size("needed"), text, "label")
    first = met.groupBy("url").agg(F.min_by(F.struct("label", "confidence", text.alias("mined")), order).alias("best"))
    return first.select("url", "best.*")


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = LISTED) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) of every row of ``pages`` (page_id, url).

    ``labelled`` (url, label) are URLs with the label block or allow. ``mined`` is the mined rule that decided, where no listed one did.
    """
    with Scratch(pages.sparkSession) as scratch:
        index = mine(labelled, scratch)
        split = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
        rule, verdict = listed(F.col("host"), F.col("path"), rules)
        split = split.select("*", rule.alias("rule"), verdict.alias("listed"))
        open_ = split.withColumn("url", F.when(F.col("rule").isNull(), F.col("url")))
        found = scratch.cut(learned(open_, index))
        judged = open_.join(found, "url", "left")
        says = F.coalesce("listed", "label", F.lit("allow"))
        return cut(judged.select("page_id", "host", "path", "rule", says.alias("verdict"), "mined", "confidence"))


def labels_of_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label) of the pages that ``labels`` (doc_id, quality, toxic) knows: toxic ones and those of no quality are to be blocked."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    label = F.when(F.coalesce(bad, F.lit(False)), "block").when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), "allow")
    known = labels.select(F.col("doc_id").alias("page_id"), label.alias("label"))
    return pages.select("page_id", "url").join(known, "page_id").select("url", "label")
