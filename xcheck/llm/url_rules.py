"""URL filtering by fixed rules and mined association rules.

A url whose host and path fit a fixed rule gets its verdict (the longest rule
wins). The others are judged by rules that Spark's FP-growth mines from labelled
pages: combinations of url tokens that go with bad labels often enough
(support) and surely enough (confidence). A mined rule is indexed under its
rarest token; a url meets only the rules of its own tokens and is blocked if it
holds all tokens of one.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

# Fixed values: (host, path, verdict); a rule fits its host and all subdomains
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MIN_SUPPORT = 0.002     # of labelled pages
MIN_PAGES = 20          # least labelled pages of a rule
MIN_CONFIDENCE = 0.8
BAD = "label=bad"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, nulls if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host parts, words of the path that are no numbers, query and fragment parts."""
    parts = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(path, r"[/.]"), lambda x: (x != "") & ~x.rlike(r"^\d+$")), lambda x: F.concat(F.lit("p:"), x))
    more = F.transform(F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1), "[?&#]"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), x))
    return F.array_distinct(F.concat(parts, words, more))


def mine_rules(tokens: DataFrame, min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, confidence, support) of rules for bad labels from (tokens, bad)."""
    items = tokens.select(F.when(F.col("bad"), F.array_union("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    n = items.count()
    kind = "antecedent array<string>, confidence double, support double"
    if not n:
        return tokens.sparkSession.createDataFrame([], kind)
    support = min(1.0, max(min_support, min_pages * min_confidence / n))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    with_bad = sets.filter(F.array_contains("items", BAD)).select(F.array_remove("items", BAD).alias("antecedent"), F.col("freq").alias("bad_pages"))
    whole = sets.filter(~F.array_contains("items", BAD)).select(F.col("items").alias("antecedent"), F.col("freq").alias("pages"))
    rules = with_bad.filter(F.size("antecedent") > 0).join(whole, "antecedent").filter(F.col("pages") >= min_pages)
    return (rules.select("antecedent", (F.col("bad_pages") / F.col("pages")).alias("confidence"), (F.col("pages") / n).alias("support"))
            .filter(F.col("confidence") >= min_confidence))


def url_verdicts(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id",
                 min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, host, path, rule, verdict), one row for each row of ``pages``.

    A page shows the document whose number is its path's first all-digit
    segment; that document's label (bad: quality 0 or toxic 1; two labels of one
    document: bad if one is) teaches the mined rules. Null urls and urls without
    ``://`` have an empty host and path, fit no rule and are allowed; null labels
    teach nothing; repeated rows each get their row and count each; no labels,
    no mined rules. Other columns are not looked at."""
    url = F.col("url")
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rule, fixed = fixed_rule(F.col("host"), F.col("path"))
    judged = plain.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("rule", rule).withColumn("fixed", fixed)
    tagged = judged.withColumn("tokens", tokens_of(F.coalesce(url, F.lit("")), F.col("host"), F.col("path")))
    number = F.regexp_extract("path", r"/(\d{1,18})(?=[/.]|$)", 1)
    marks = (labels.select(F.col(label_id).cast("string").alias("number"), F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.col("quality") == 0, F.col("toxic") == 1).alias("bad"))
             .filter("bad is not null and number is not null").groupBy("number").agg(F.max("bad").alias("bad")))
    known = tagged.filter("url is not null").withColumn("number", number).filter("number <> ''").join(marks, "number").select("tokens", "bad")
    known = written(known, "labelled-urls")
    rules = written(mine_rules(known, min_support, min_pages, min_confidence).withColumn("rule_id", F.monotonically_increasing_id()), "url-rules")
    # inverted index: a rule under the token that fewest labelled urls have
    common = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    index = (rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token")).join(common, "token")
             .groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("antecedent").alias("antecedent")))
    urls = tagged.filter("fixed is null and url is not null").select("url", "tokens").distinct()
    hits = (urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
            .filter(F.size(F.array_except("antecedent", "tokens")) == 0).select(F.col("url").alias("bad_url")).distinct())
    out = judged.join(hits, F.col("url") == F.col("bad_url"), "left")
    learned = F.when(F.col("bad_url").isNotNull(), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", learned).alias("verdict"))
