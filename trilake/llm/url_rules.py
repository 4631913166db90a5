"""URL filters: fixed host and path rules, and association rules mined from labels."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trilake.llm.common import stored
from trilake.operators.joins import lookup_join

#: Host and path of a rule in one string, and what it says.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: A mined rule marks at least so many bad labelled pages, whatever the size of the table
#: (and this share of all labelled pages, if asked for).
MIN_PAGES, MIN_SUPPORT = 5, 0.0
MIN_CONFIDENCE = 0.6
#: So many standard errors that its confidence stands above the share of bad pages among all
#: (Wilson's lower bound): one set of tokens in 3.5 million passes by chance.
MIN_Z = 5.0
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, ADDRESS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, ADDRESS, 2)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def tokens(url: Column) -> Column:
    """The different runs of letters and digits of an address, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def token_classes(items: DataFrame) -> DataFrame:
    """token, rep, n, b: tokens of the same rows share the representative `rep`, the least of them.

    `items`: tokens, bad, h (a hash of the address). n rows and b bad rows hold the token;
    these and the sum of the rows' hashes tell which tokens always stand together.
    """
    each = items.select(F.explode("tokens").alias("token"), F.col("bad").cast("long").alias("b"), F.col("h").cast("decimal(38,0)").alias("h"))
    held = stored(each.groupBy("token").agg(F.count("*").alias("n"), F.sum("b").alias("b"), F.sum("h").alias("h")), "url-tokens")
    least = held.groupBy("n", "b", "h").agg(F.min("token").alias("rep"))
    return stored(held.join(least, ["n", "b", "h"]).select("token", "rep", "n", "b"), "url-classes")


def with_reps(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct representatives of each row's tokens as `tokens`; `rows`: id, tokens and
    columns that belong to the id. Rows without any are left out."""
    others = [c for c in rows.columns if c != "tokens"]
    known = lookup_join(rows.select(*others, F.explode("tokens").alias("token")), classes.select("token", "rep"), ["token"], "inner")
    return known.groupBy(*others).agg(F.array_sort(F.collect_set("rep")).alias("tokens"))


def _mined(labelled: DataFrame, min_support: float, min_pages: int, min_confidence: float, min_z: float) -> tuple[DataFrame, DataFrame]:
    """The minimal rules over representatives, and the classes of tokens they stand for."""
    url = F.col("url")
    items = stored(labelled.where("bad is not null").select(tokens(url).alias("tokens"), "bad", F.xxhash64("url").alias("h")), "url-items")
    n_all, n_bad = items.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    classes = token_classes(items)
    floor = max(min_pages, min_support * n_all, 1)
    base = n_bad / n_all if n_all else 0.0

    def holds(rows: DataFrame) -> DataFrame:
        """Rules among sets: tokens, n (rows with the set), b (bad ones among them)."""
        n, share, z = F.col("n").cast("double"), F.col("b") / F.col("n"), F.lit(float(min_z))
        spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
        least = (share + z * z / (2 * n) - spread) / (1 + z * z / n)
        return rows.where((F.col("b") >= floor) & (share >= min_confidence) & (least >= base))

    reps = classes.where((F.col("token") == F.col("rep")) & (F.col("b") >= floor)).select(F.array("rep").alias("tokens"), "n", "b")
    found = [stored(holds(reps), "url-rules-1")]
    # no longer rule that is minimal has a token that is a rule by itself
    open_reps = stored(reps.join(found[0].select("tokens"), "tokens", "left_anti").select(F.col("tokens")[0].alias("rep")), "url-open")
    members = classes.join(open_reps, "rep").select("token", "rep")
    ids = items.withColumn("id", F.monotonically_increasing_id())
    rows = stored(with_reps(ids.select("id", "bad", "tokens"), members).where(F.size("tokens") > 1), "url-rows")
    bad_rows = rows.where("bad")
    n_rows = bad_rows.count()
    if n_rows >= floor:
        model = FPGrowth(itemsCol="tokens", minSupport=max(0.0, (floor - 0.5) / n_rows), minConfidence=1.0).fit(bad_rows)
        sets = stored(model.freqItemsets.where(F.size("items") > 1).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("b")), "url-sets")
        counts = classes.select(F.col("rep").alias("token"), "n").distinct()
        dead = None
        for size in range(2, (sets.agg(F.max(F.size("tokens"))).first()[0] or 1) + 1):  # lengths of sets
            level = sets.where(F.size("tokens") == size)
            covered = level.select("tokens").limit(0)
            if dead is not None:
                parts = F.transform("tokens", lambda t: F.array_remove("tokens", t))
                covered = level.select("tokens", F.explode(parts).alias("part")).join(dead.withColumnRenamed("tokens", "part"), "part").select("tokens").distinct()
                level = level.join(covered, "tokens", "left_anti")
            level = stored(level, "url-level")
            keyed = with_key(level.select("tokens"), counts).select("key", F.col("tokens").alias("rule"))
            good = matches(rows.where("not bad").select("tokens"), keyed).groupBy(F.col("rule").alias("tokens")).count()
            counted = level.join(good, "tokens", "left").withColumn("n", F.col("b") + F.coalesce("count", F.lit(0)))
            found.append(stored(holds(counted).select("tokens", "n", "b"), "url-rules-n"))
            dead = stored(covered.unionByName(found[-1].select("tokens")), "url-dead")
    rules = with_key(reduce(DataFrame.unionByName, found), classes.select(F.col("rep").alias("token"), "n").distinct())
    share = F.col("b") / F.col("n")
    rules = rules.select("tokens", "key", share.alias("confidence"), (share / F.lit(base or 1.0)).alias("lift"), (F.col("b") / F.lit(float(n_all or 1))).alias("support"))
    return stored(rules, "url-rules"), classes


def with_key(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """`sets` with `key`: the token of each that the fewest rows hold, by `counts` (token, n)."""
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(counts.withColumnRenamed("n", "_n"), "token")
    rarest = each.groupBy("tokens").agg(F.min(F.struct("_n", "token"))["token"].alias("key"))
    return sets.join(rarest, "tokens")


def mine_rules(labelled: DataFrame, min_support=MIN_SUPPORT, min_pages=MIN_PAGES, min_confidence=MIN_CONFIDENCE, min_z=MIN_Z) -> DataFrame:
    """Token combinations that mark bad pages: tokens, key, confidence, lift, support.

    `labelled`: url, bad. Tokens that always stand together count as one, the least of
    them; single tokens that are rules leave before FP-growth mines the bad pages, so sets
    of tokens that one bad site shares are not spelled out. Sets are counted on the other
    pages level by level, below a rule not at all. A rule is kept if it has the pages,
    the confidence and the significance asked for, and no part of it is a rule already.
    key: its rarest token, under which the inverted index lists it.
    """
    return _mined(labelled, min_support, min_pages, min_confidence, min_z)[0]


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of `sets` (tokens and more) with each of `rules` (key, rule and more) that
    is part of their tokens; by the inverted index of rules under their rarest token."""
    listed = sets.withColumn("key", F.explode("tokens"))
    return listed.join(rules, "key").where(F.size(F.array_except("rule", "tokens")) == 0).drop("key")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **limits: float) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, n_matched of every page.

    The longest fixed rule that fits decides; else a page is blocked if a mined rule
    matches, and allowed if none does. `labels` (doc_id, quality) names bad pages by
    quality 0; a page's label is the one with its id, the lowest if there are several.

    A null url, or one without ``://``, has an empty host and path and no rule can fit
    it; a null url has no tokens and is allowed. Null labels are none. Repeated pages
    are judged alike. Without labels nothing is mined. An empty table gives no rows.
    """
    bad = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("bad"))
    addresses = pages.select("page_id", "url")
    asked = {"min_support": MIN_SUPPORT, "min_pages": MIN_PAGES, "min_confidence": MIN_CONFIDENCE, "min_z": MIN_Z} | limits
    mined, classes = _mined(addresses.join(bad, "page_id").select("url", "bad"), **asked)
    used = mined.select(F.explode("tokens").alias("rep")).distinct()
    members = classes.join(used, "rep").select("token", "rep")
    # each address once, as one may stand on a third of all pages; both inputs of the join
    # to the pages are tables, so adaptive execution can split such an address
    urls = addresses.where("url is not null").select("url").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    found = matches(with_reps(urls, members), mined.select("key", F.col("tokens").alias("rule"), "confidence"))
    found = found.groupBy("url").agg(F.max("confidence").alias("confidence"), F.countDistinct("rule").alias("n_matched"))
    found = stored(found, "url-matches")
    host, path = host_and_path(F.col("url"))
    judged = addresses.join(found, "url", "left").withColumn("host", host).withColumn("path", path)
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    mined_verdict = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined_verdict).alias("verdict"),
        "confidence", F.coalesce("n_matched", F.lit(0)).cast("long").alias("n_matched"),
    )
