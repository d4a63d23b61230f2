"""URL filters: host and path rules first, then a ratio of two character language models; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm.common import cut, read

#: (rule, verdict); a rule is a host, then a path from its first slash on.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
START, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty for null or a url without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Of equal lengths the longer host wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"), r[1] == "block")):
        own, under = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(under)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _grams(rows: DataFrame, order: int, *keep: str) -> DataFrame:
    """A row for each character of a url: gram, that character after the order characters before it.

    Grams are made from an array of characters, in time linear in the url; rows carry keep and no url.
    """
    chars = F.split(F.concat(F.lit(START * order), F.coalesce("url", F.lit("")), F.lit(END)), "")
    n, grams = F.size(chars), chars
    for j in range(1, order + 1):
        grams = F.zip_with(grams, F.slice(chars, F.lit(j + 1), n), lambda x, y: F.concat(x, y))
    return rows.select(*keep, F.explode(F.slice(grams, F.lit(1), n - order)).alias("gram"))


def _dealt(rows: DataFrame, each: int = 1 << 20) -> DataFrame:
    """rows with about each characters a task: adaptive execution can't see that a url becomes a row for each character."""
    total = rows.agg(F.sum(F.length("url"))).first()[0] or 0
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each)), F.xxhash64("url"))


def gram_counts(labelled: DataFrame, order: int) -> DataFrame:
    """(gram, a, r): how often accepted and rejected urls hold each character after its context.

    labelled: url, side ('a' accepted, 'r' rejected). Counts cover all labelled urls; they are summed
    before they are dealt, so a gram in every url costs one row a task.
    """
    return _grams(labelled, order, "side").groupBy("gram").agg(F.sum(F.when(F.col("side") == "a", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == "r", 1).otherwise(0)).alias("r"))


def log_ratios(counts: DataFrame, wanted: DataFrame, order: int, pseudo: float, alphabet: int) -> DataFrame:
    """(gram, ratio): log p_accepted(c | context) - log p_rejected(c | context) of each wanted gram.

    p_0 is uniform over the alphabet; p_k(c | k-1 last characters) adds pseudo times p_(k-1) to the
    counts, from no context up to order characters: where a context was never seen, the shorter one
    decides. Contexts are looked up by joins of distinct grams, not of urls.
    """
    out = wanted.select("gram").withColumns({f"_{s}": F.lit(1.0 / alphabet) for s in "ar"})
    for k in range(order + 1):
        tail = F.substring("gram", order + 1 - k, k + 1)
        both = counts.groupBy(tail.alias("_t")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        context = both.groupBy(F.substring("_t", 1, k).alias("_c")).agg(F.sum("na").alias("ca"), F.sum("nr").alias("cr")) if k else both.agg(F.sum("na").alias("ca"), F.sum("nr").alias("cr"))
        out = out.withColumn("_t", tail).join(both, "_t", "left")
        out = out.withColumn("_c", F.substring("_t", 1, k)).join(context, "_c", "left") if k else out.join(context)
        step = lambda n, c, p: (F.coalesce(F.col(n), F.lit(0)) + pseudo * F.col(p)) / (F.coalesce(F.col(c), F.lit(0)) + pseudo)
        out = out.select("gram", step("na", "ca", "_a").alias("_a"), step("nr", "cr", "_r").alias("_r"))
    return out.select("gram", (F.log("_a") - F.log("_r")).alias("ratio"))


def filter_urls(pages: DataFrame, rules=RULES, order: int = 3, pseudo: float = 2.0, alphabet: int = 256) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): verdict by the longest rule that fits, else by language models.

    Urls that rules accept or reject train one smoothed character model each (orders 0 to order). A
    url's score is the difference of their log-likelihoods by character; four fifths of the labelled
    urls give the counts, and the other fifth calibrates: the mean scores of its accepted and rejected
    urls, weighed by their spreads, set the threshold. A score at or above it allows.

    Null or empty url: host and path empty, no rule, score of the end mark alone. No labelled url of
    one side (as in an empty table): threshold 0. Equal urls get equal verdicts; other columns of
    pages are not read. A quote, newline or any other character in a url is a character.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = cut(base.withColumn("rule", rule).withColumn("_says", verdict), "urls")

    # A number stands for each url, so that its grams don't each carry all of it.
    texts = cut(base.groupBy("url", "_says").agg(F.count(F.lit(1)).alias("_n")).withColumn("_u", F.monotonically_increasing_id()), "urls-texts")
    held = F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(5)) == 0
    labelled = base.where(F.col("_says").isNotNull() & ~held).select("url", F.when(F.col("_says") == "allow", "a").otherwise("r").alias("side"))
    counts = cut(gram_counts(labelled, order), "urls-counts")
    scored = _dealt(texts.where(F.col("_says").isNull() | held))
    each = cut(_grams(scored, order, "_u", "_says").groupBy("_u", "_says", "gram").agg(F.count(F.lit(1)).alias("_n")), "urls-grams")
    ratios = cut(log_ratios(counts, each.select("gram").distinct(), order, pseudo, alphabet), "urls-ratios")
    score = each.join(ratios, "gram").groupBy("_u", "_says").agg((F.sum(F.col("ratio") * F.col("_n")) / F.sum("_n")).alias("score"))
    score = cut(score, "urls-score")
    m = score.where(F.col("_says").isNotNull()).groupBy("_says").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s"))
    side = lambda what, c: F.max(F.when(F.col("_says") == what, F.col(c)))
    got = m.agg(side("allow", "m").alias("ma"), side("block", "m").alias("mr"), side("allow", "s").alias("sa"), side("block", "s").alias("sr"))
    cut_at = F.coalesce((F.col("ma") * (F.col("sr") + 1e-6) + F.col("mr") * (F.col("sa") + 1e-6)) / (F.col("sa") + F.col("sr") + 2e-6), F.lit(0.0))
    threshold = got.select(cut_at.alias("_at"))  # one row
    free = score.where("_says IS NULL").select("_u", "score").join(texts.select("_u", F.col("url").alias("_url")), "_u").select("_url", "score").alias("s")
    out = base.alias("b").join(free, F.col("b.url").eqNullSafe(F.col("s._url")) & F.col("b._says").isNull(), "left").join(F.broadcast(threshold))
    by_model = F.when(F.coalesce("score", F.lit(0.0)) >= F.col("_at"), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_says", by_model).alias("verdict"), "score", F.col("_at").alias("threshold"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8: rules, then the ratio of the two character models, over all pages."""
    return filter_urls(read(spark, sf_dir, "pages"))


QUERIES = {"op8_url_filter": op8_url_filter}
SQL: dict[str, str] = {}
