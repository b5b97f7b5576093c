"""URL filtering by association rules.

The tokens of a labelled url (its host and parent domains, words of the host, path parts, query keys,
shape) and its label form a transaction. Spark's FP-growth mines the frequent token sets; those whose
confidence for a label and lift over the label's share are high enough become rules, and a rule that a
shorter one makes needless goes. Rules meet urls through an inverted index: each rule is listed under its
rarest token only and checked against the rest of the url's tokens. The surest rule that fits decides, a
url without one is allowed. A list of given rules (host and path prefix) goes first; the longest that fits
wins. Without labels of their own, urls that a given rule decides are labelled by it, so that the mined
rules carry the list's verdicts over to urls that it does not name.

Subsets of tokens that say the same would make FP-growth list 2^k sets, so they are reduced before, without
loss: of tokens that occur in the same labelled urls one stays; a token that decides alone (confidence 1)
is a rule and leaves the transactions, since longer rules with it are needless; and since a host's domains
imply each other, a transaction is written once for each of its domains that is left, with that one only.

Defined results: a null or empty url, or one without "://", has an empty host and path, fits no rule and is
allowed; long urls are read whole; rows repeat as often as in the input, each labelled row counting as a
transaction; of equally sure rules the one with more support decides, then the blocking one; an empty table
gives no rows; without labels, or with one label only, nothing is mined. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Least share of labelled urls and least number that a rule stands on; least confidence and lift.
SUPPORT, EVIDENCE, CONFIDENCE, LIFT = 0.002, 5, 0.8, 1.1
#: Labelled urls that a partition of FP-growth aims at.
ROWS = 50_000
ALLOW, BLOCK = "allow", "block"
#: The order in which one of several tokens that occur in the same urls is chosen.
KINDS = ("host:", "word:", "path:", "key:", "scheme:", "depth:")
RULES = "tokens array<string>, verdict string, confidence double, lift double, support double, anchor string"


def host_of(url: Column) -> Column:
    """The host, A-Z lower-cased; '' if there is none."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """The path, up to a query or fragment; '' if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, 'host/path') rules that fits; null for none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, n), ".")))
    words = F.transform(F.filter(F.split(host, r"[.\-_]"), lambda w: w != ""), lambda w: F.concat(F.lit("word:"), w))
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: p != "")
    pieces = F.transform(parts, lambda p: F.concat(F.lit("path:"), F.when(p.rlike(r"^\d+$"), F.lit("#")).otherwise(p)))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda q: q != ""), lambda q: F.concat(F.lit("key:"), F.split(q, "=")[0]))
    shape = F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))), F.concat(F.lit("depth:"), F.size(parts).cast("string")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, words, pieces, keys, shape)))


def _kind(token: Column) -> Column:
    return F.array_position(F.lit([k[:-1] for k in KINDS]), F.substring_index(token, ":", 1))


def reduced(rows: DataFrame, least: int) -> tuple[list[str], list[tuple[str, str, int, int]]]:
    """(tokens that stay, (token, verdict, urls with both, urls with the token) of those that decide alone)
    of rows with tokens, verdict and row (a hash of its own), among the tokens of at least so many rows. Their number is bounded by
    the tokens of a url over the least share."""
    listed = rows.select(F.explode("tokens").alias("token"), "verdict", F.col("row").cast("decimal(38,0)").alias("_h"))
    counts = listed.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("_h").alias("h"), F.count(F.when(F.col("verdict") == BLOCK, 1)).alias("blocked")).filter(F.col("n") >= least)
    # The sum of the rows' hashes tells the sets of rows apart.
    one = counts.groupBy("n", "h", "blocked").agg(F.min_by("token", F.struct(_kind(F.col("token")), F.length("token"), F.col("token"))).alias("token"))
    found = one.select("token", "n", "blocked").collect()
    alone = [(r["token"], BLOCK if r["blocked"] else ALLOW, r["n"], r["n"]) for r in found if r["blocked"] in (0, r["n"])]
    return [r["token"] for r in found if 0 < r["blocked"] < r["n"]], alone


def transactions(rows: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """items: the tokens that stay and the verdict. A row with several domains has a transaction for each,
    whose items are marked with the domain's place; without one it has a transaction with place 0."""
    stay = F.filter("tokens", lambda t: t.isin(list(tokens)) if tokens else F.lit(False))
    domains = F.sort_array(F.transform(F.filter(stay, lambda t: t.startswith("host:")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))
    others = F.filter(stay, lambda t: ~t.startswith("host:"))
    rows = rows.select(domains.alias("domains"), F.array_append(others, F.concat(F.lit("verdict:"), F.col("verdict"))).alias("others"))
    places = F.sequence(F.lit(0), F.greatest(F.size("domains") - 1, F.lit(0)))
    copies = rows.select("others", "domains", F.explode(places).alias("place"))
    own = F.when(F.size("domains") > 0, F.array(F.get("domains", F.col("place"))["t"])).otherwise(F.array().cast("array<string>"))
    return copies.select(F.transform(F.concat("others", own), lambda t: F.concat(F.col("place").cast("string"), F.lit("|"), t)).alias("items"))


def mine(labelled: DataFrame, support: float = SUPPORT, evidence: int = EVIDENCE, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules (tokens, verdict, confidence, lift, support, anchor) from rows of tokens and a verdict."""
    spark = labelled.sparkSession
    rows = materialize(labelled.filter((F.size("tokens") > 0) & F.col("verdict").isNotNull()).select("tokens", "verdict", F.xxhash64(F.monotonically_increasing_id()).alias("row")))
    total, blocked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("verdict") == BLOCK, 1))).first()
    if not 0 < blocked < total:
        discard(rows)
        return spark.createDataFrame([], RULES)
    least = max(evidence, -(-int(total * support * 10**9) // 10**9))
    stay, alone = reduced(rows, least)
    share = {BLOCK: blocked / total, ALLOW: 1 - blocked / total}
    single = [([t], v, n / m, n / m / share[v], n / total) for t, v, n, m in alone]
    rules = spark.createDataFrame(single, "tokens array<string>, verdict string, confidence double, lift double, support double")
    items = materialize(transactions(rows, stay).repartition(max(1, -(-total // ROWS))))
    many = items.count()
    sets = FPGrowth(itemsCol="items", minSupport=least / many, minConfidence=1.0, numPartitions=max(spark.sparkContext.defaultParallelism, -(-many // ROWS))).fit(items).freqItemsets
    place = F.substring_index(F.col("items")[0], "|", 1)
    sets = sets.select(place.alias("place"), F.transform("items", lambda i: F.substring(i, F.instr(i, "|") + 1, 1 << 30)).alias("items"), "freq")
    # Beyond the first place only sets with a domain are counted in full.
    sets = materialize(sets.filter((F.col("place") == "0") | F.exists("items", lambda i: i.startswith("host:"))).filter(F.col("freq") >= least))
    of_label = lambda i: i.startswith("verdict:")
    bare = sets.filter(~F.exists("items", of_label)).select("place", F.array_sort("items").alias("tokens"), F.col("freq").alias("all"))
    both = sets.filter(F.exists("items", of_label) & (F.size("items") > 1)).select("place", F.array_sort(F.filter("items", lambda i: ~of_label(i))).alias("tokens"), F.substring(F.filter("items", of_label)[0], 9, 99).alias("verdict"), "freq")
    mined = both.join(bare, ["place", "tokens"]).withColumn("confidence", F.col("freq") / F.col("all"))
    mined = mined.withColumn("lift", F.col("confidence") / F.when(F.col("verdict") == BLOCK, share[BLOCK]).otherwise(share[ALLOW])).withColumn("support", F.col("freq") / F.lit(total))
    rules = rules.union(mined.select(*rules.columns)).filter((F.col("confidence") >= confidence) & (F.col("lift") >= lift))
    rules = materialize(rules)
    # A rule goes if a part of its tokens is a rule for the same verdict that is at least as sure.
    shorter = rules.select(F.col("tokens").alias("part"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c"), F.element_at("tokens", 1).alias("first"))
    listed = rules.withColumn("first", F.explode("tokens"))
    needless = listed.join(shorter, "first").filter((F.col("verdict") == F.col("_v")) & (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("_c") >= F.col("confidence")))
    kept = rules.join(needless.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti")
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    anchors = kept.withColumn("token", F.explode("tokens")).join(counts, "token").groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("n", "token")).alias("anchor"))
    found = materialize(kept.join(anchors, ["tokens", "verdict"]).select("tokens", "verdict", "confidence", "lift", "support", "anchor"))
    discard(rows, items, sets, rules)
    return found


def judge(rows: DataFrame, rules: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """key and mined, the verdict of the surest rule, for the rows that a rule fits. Keys are distinct."""
    listed = rows.select(key, F.col(tokens).alias("_all"), F.explode(tokens).alias("anchor"))
    fits = listed.join(rules, "anchor").filter(F.size(F.array_except("tokens", "_all")) == 0)
    # Of equally sure rules the one with more support, then the blocking one.
    sure = F.struct("confidence", "support", "verdict")
    return fits.groupBy(key).agg(F.max(sure).alias("_top")).select(key, F.col("_top.verdict").alias("mined"), F.col("_top.confidence").alias("confidence"))


def filter_urls(df: DataFrame, given: Sequence[tuple[str, str]], labels: DataFrame | None = None, url: str = "url", key: str = "page_id", **thresholds: float) -> DataFrame:
    """key, host, path, rule, verdict and confidence (of the mined rule) of every row.

    labels: rows of the key and quality (0: to block); without them a url is labelled by the given rule that
    fits it. Distinct token sets are judged once, so that a host with many pages costs no more than its kinds
    of urls."""
    rows = df.select(F.col(key), F.col(url).alias("_url"))
    found = rows.select(key, host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), F.array_sort(tokens_of(F.col("_url"))).alias("tokens"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), given)
    if labels is None:
        labelled = found.select("tokens", verdict.alias("verdict"))
    else:
        marked = labels.filter(F.col("quality").isNotNull()).groupBy(key).agg(F.min("quality").alias("_quality"))
        labelled = found.hint("merge").join(materialize(marked).hint("merge"), key).select("tokens", F.when(F.col("_quality") == 0, BLOCK).otherwise(ALLOW).alias("verdict"))
    rules = mine(labelled, **thresholds)
    found = found.withColumn("_kind", F.array_join("tokens", " "))
    kinds = found.groupBy("_kind").agg(F.first("tokens").alias("tokens"))
    # Written, so that the join's sides are plain shuffles, whose skewed partitions Spark splits.
    judged = materialize(judge(kinds, rules, "_kind"))
    discard(rules)
    return found.hint("merge").join(judged.hint("merge"), "_kind", "left").select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("mined"), F.lit(ALLOW)).alias("verdict"), F.when(rule.isNull(), F.col("confidence")).alias("confidence"))
