"""URL filtering: host and path rules, and association rules mined from labels, in DataFrame operations only.

FP-growth finds combinations of URL tokens that go with a label. Tokens that stand on the very same labelled pages say the same, so
one of them stands for all while combinations are listed. Rules under a support or confidence are pruned, and so are those that a
rule with fewer tokens serves as well. All of the rest are kept in an inverted index under their rarest token, to which the tokens
of each URL are joined.
"""

from __future__ import annotations

import math
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mdframe.llm.common import staged, table, unstage

MIN_SUPPORT = 0.004
#: A combination of tokens is on at least so many labelled pages.
MIN_COUNT = 8
MIN_CONFIDENCE = 0.6
#: Characters of mined rules up to which their index is broadcast; a larger one is joined by a shuffle.
BROADCAST_CHARS = 2_000_000
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LABELS = {"=block": "block", "=allow": "allow"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Verdict and string of the longest rule that fits a host or its subdomains and the start of a path; null where none does."""
    verdict, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        verdict, name = F.when(fits, F.lit(kind)).otherwise(verdict), F.when(fits, F.lit(rule)).otherwise(name)
    return verdict, name


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels and words in them, path segments without bare numbers, file ending, query names, and shape."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-"))), lambda x: x != "")
    segments = F.filter(F.split(F.lower(path), "/"), lambda x: ~F.rlike(x, F.lit(r"^[0-9]*$")))
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: x != "")
    ending = F.regexp_extract(F.lower(path), r"\.([a-z0-9]{1,5})$", 1)
    all_of = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))),
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)), F.transform(words, lambda x: F.concat(F.lit("word:"), x)),
        F.transform(segments, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "0"))),
        F.transform(query, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
        F.when(ending != "", F.array(F.concat(F.lit("ending:"), ending))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("depth:"), F.least(F.size(segments), F.lit(5)).cast("string"))),
    )
    return F.array_distinct(all_of)


def _merged(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Of rows ``(rid, y, tokens)`` the classes of tokens that stand on the same rows, ``(token, members)`` by their first token, and the rows
    with first tokens only. Tokens of fewer than ``least`` rows are in no rule. Row sets are compared by their size and two xors of hashes."""
    each = rows.select("rid", "y", F.explode("tokens").alias("token"))
    places = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("z"))
    classes = places.where(F.col("n") >= least).groupBy("n", "x", "z").agg(F.sort_array(F.collect_list("token")).alias("members"))
    classes = staged(classes.select(F.get("members", F.lit(0)).alias("token"), "members"), "url-classes")
    kept = each.join(classes.select("token"), "token").groupBy("rid", "y").agg(F.collect_set("token").alias("tokens"))
    return classes, kept


def mined_rules(pages: DataFrame, labels: DataFrame, label: str = "quality", support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """All rules ``tokens -> block or allow`` of all labelled pages (label 0: block) that no rule with fewer tokens serves as well.

    A row ``(tokens, verdict, confidence, support)`` for each; no labelled page, no rule. Each of ``tokens`` is an array of tokens that went together on
    the labelled pages, any of which will do. Each level of rules with one token more looks up the best confidence among its rules'
    proper subsets in the level below, which holds them all, as they are as frequent.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(label).alias("y"))
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").join(known, "page_id")
    rows = staged(rows.select(F.monotonically_increasing_id().alias("rid"), "y", url_tokens(F.col("url"), host, path).alias("tokens")), "url-rows")
    shares = {r[0]: r[1] for r in rows.groupBy((F.col("y") == 0)).count().collect()}
    total = sum(shares.values())
    if not total:
        unstage(rows)
        return pages.sparkSession.createDataFrame([], "tokens array<array<string>>, verdict string, confidence double, support double")
    share = min(1.0, max(support, MIN_COUNT / total))
    classes, kept = _merged(rows, math.ceil(share * total))
    # rows without such a token count too, as they are in the shares
    kept = rows.select("rid", "y").join(kept.drop("y"), "rid", "left")
    baskets = staged(kept.select(F.array_append(F.coalesce("tokens", F.array().cast("array<string>")), F.when(F.col("y") == 0, "=block").otherwise("=allow")).alias("items")), "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=share).fit(baskets)
    sets = staged(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    block = F.array_contains("items", "=block")
    found = sets.where(block | F.array_contains("items", "=allow")).select(
        F.filter("items", lambda t: ~t.isin(*LABELS)).alias("tokens"), F.when(block, "block").otherwise("allow").alias("verdict"), F.col("freq").alias("both")
    )
    found = found.where(F.size("tokens") > 0).join(sets.select(F.col("items").alias("tokens"), "freq"), "tokens")
    found = found.select("tokens", "verdict", (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / F.lit(total)).alias("support"))
    found = staged(found, "url-found")
    levels = [found.where(F.size("tokens") == 1).withColumn("below", F.lit(0.0))]
    for size in range(2, (found.agg(F.max(F.size("tokens"))).first()[0] or 0) + 1):
        best = levels[-1].select(F.col("tokens").alias("sub"), "verdict", F.greatest("confidence", "below").alias("best"))
        own = found.where(F.size("tokens") == size).select("*", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("sub"))
        own = own.join(best, ["sub", "verdict"], "left").groupBy("tokens", "verdict", "confidence", "support").agg(F.coalesce(F.max("best"), F.lit(0.0)).alias("below"))
        levels.append(staged(own, "url-level"))
    lift = F.col("confidence") / F.when(F.col("verdict") == "block", shares.get(True, 0) / total).otherwise(shares.get(False, 0) / total)
    kept = reduce(DataFrame.union, levels).where((F.col("confidence") > F.col("below")) & (F.col("confidence") >= confidence) & (lift > 1.0))
    kept = kept.select(F.col("tokens").alias("firsts"), "verdict", "confidence", "support", F.explode("tokens").alias("token")).join(classes, "token")
    kept = kept.groupBy("firsts", "verdict", "confidence", "support").agg(F.sort_array(F.collect_list("members")).alias("tokens"))
    kept = staged(kept.select("tokens", "verdict", "confidence", "support"), "url-rules")
    for used in (rows, classes, baskets, sets, found, *levels[1:]):
        unstage(used)
    return kept


def _matched(rows: DataFrame, mined: DataFrame) -> DataFrame:
    """``(page_id, url, m)`` of each row: ``m`` is the most confident rule that the tokens of the URL serve, as struct (confidence, support, tokens,
    verdict), or null; of ties the one with most support.

    Repeated rows are counted before the join and dealt out again after it. Tokens of many pages meet one row of the index each.
    """
    firsts = F.transform("tokens", lambda t: F.get(t, F.lit(0)))
    mined = mined.select("verdict", "confidence", "support", firsts.alias("all"), F.explode("tokens").alias("members"))
    aliases = mined.select(F.get("members", F.lit(0)).alias("first"), F.explode("members").alias("token")).distinct()
    keyed = mined.select("all", "verdict", "confidence", "support", F.get("members", F.lit(0)).alias("first"))
    used = keyed.groupBy("first").count()
    keyed = keyed.join(used, "first").groupBy("all", "verdict", "confidence", "support").agg(F.min(F.struct("count", "first"))["first"].alias("first"))
    rule = F.struct("confidence", "support", F.array_join("all", " ").alias("tokens"), "verdict", "all")
    aliases, index = staged(aliases, "url-aliases"), staged(keyed.groupBy("first").agg(F.collect_list(rule).alias("own")), "url-index")
    chars = (index.agg(F.sum(F.aggregate("own", F.lit(0), lambda a, r: a + F.length(r["tokens"])))).first()[0] or 0) + (aliases.agg(F.sum(F.length("token"))).first()[0] or 0)
    small = F.broadcast if chars <= BROADCAST_CHARS else (lambda df: df)
    host, path = host_and_path(F.col("url"))
    each = rows.select("page_id", "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("times"))
    tokens = each.select("page_id", "url", "times", F.explode_outer(url_tokens(F.col("url"), host, path)).alias("token"))
    has = tokens.join(small(aliases), "token", "left").groupBy("page_id", "url", "times").agg(F.collect_set("first").alias("has"))
    met = has.select("*", F.explode_outer("has").alias("first")).join(small(index), "first", "left")
    fits = F.filter("own", lambda r: F.forall(r["all"], lambda t: F.array_contains("has", t)))
    best = F.array_max(F.transform(fits, lambda r: F.struct(*[r[c].alias(c) for c in ("confidence", "support", "tokens", "verdict")])))
    met = met.select("page_id", "url", "times", best.alias("m")).groupBy("page_id", "url", "times").agg(F.max("m").alias("m"))
    return met.select("page_id", "url", "m", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")


def filter_urls(pages: DataFrame, mined: DataFrame | None, rules=RULES) -> DataFrame:
    """A row for each page: ``page_id, host, path, rule, verdict, mined``. The longest fitting rule decides, else the best mined rule, else ``allow``.

    ``mined`` names the rule by the first of its tokens' classes. Null and odd URLs have an empty host and path; repeated rows and null ids
    stay; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    none = F.lit(None).cast("struct<confidence:double,support:double,tokens:string,verdict:string>")
    rows = _matched(rows, mined) if mined is not None else rows.withColumn("m", none)
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    verdict, rule = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "m")
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.col("m")["verdict"], F.lit("allow")).alias("verdict"), F.col("m")["tokens"].alias("mined")
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages under the fixed rules and those mined from all labels; a row for each row (see :func:`filter_urls`)."""
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, mined_rules(pages, table(spark, sf_dir, "labels")))


#: All combinations of each labelled page's tokens, counted; for tables of the size of a test.
OP1_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
         row_number() OVER () AS rid
  FROM pages),
h AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
s AS (
  SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels, list_filter(string_split(lower(path), '/'), lambda x: NOT regexp_full_match(x, '[0-9]*')) AS segments,
         regexp_extract(lower(path), '\.([a-z0-9]{1,5})$', 1) AS ending
  FROM h),
k AS (
  SELECT page_id, rid, host, path, list_distinct(list_concat(
    ['scheme:' || lower(split_part(url, '://', 1)), 'depth:' || least(len(segments), 5)], list_transform(labels, lambda x: 'host:' || x),
    list_transform(list_filter(flatten(list_transform(list_filter(labels, lambda x: contains(x, '-')), lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'word:' || x),
    list_transform(segments, lambda x: 'path:' || regexp_replace(x, '[0-9]+', '0', 'g')),
    list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'query:' || split_part(x, '=', 1)),
    CASE WHEN ending <> '' THEN ['ending:' || ending] ELSE [] END)) AS tokens
  FROM s),
y AS (SELECT doc_id AS page_id, max(quality) AS y FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
lab AS (SELECT rid, CASE WHEN y = 0 THEN 'block' ELSE 'allow' END AS verdict, tokens FROM k JOIN y USING (page_id)),
n AS (SELECT count(*) AS total, ceil(least(1.0::DOUBLE, greatest(0.004::DOUBLE, 8 / count(*)::DOUBLE)) * count(*)) AS least FROM lab),
tok AS (SELECT rid, unnest(tokens) AS token FROM lab),
cls AS (SELECT list_sort(list(token)) AS members FROM (SELECT token, list_sort(list(rid)) AS r FROM tok GROUP BY 1 HAVING count(*) >= (SELECT least FROM n)) GROUP BY r),
al AS (SELECT members[1] AS first, unnest(members) AS token FROM cls),
bas AS (SELECT rid, verdict, list_sort(list(token)) AS t FROM lab JOIN tok USING (rid) JOIN (SELECT DISTINCT first AS token FROM al) USING (token) GROUP BY 1, 2),
sub AS (
  SELECT verdict, list_filter(t, lambda x, i: (b >> (i - 1)) & 1 = 1) AS t FROM (SELECT verdict, t, unnest(range(1, (1::BIGINT << len(t)))) AS b FROM bas)),
f AS (SELECT t, count(*) AS freq, count(*) FILTER (verdict = 'block') AS block, count(*) FILTER (verdict = 'allow') AS allow FROM sub GROUP BY 1),
r AS (
  SELECT t, verdict, both_ / freq::DOUBLE AS confidence, both_ / (SELECT total FROM n)::DOUBLE AS support
  FROM (SELECT t, freq, 'block' AS verdict, block AS both_ FROM f UNION ALL SELECT t, freq, 'allow', allow FROM f) WHERE both_ >= (SELECT least FROM n)),
g AS (
  SELECT r.t, r.verdict, r.confidence, r.support, array_to_string(r.t, ' ') AS name FROM r
  WHERE confidence >= 0.6 AND confidence / ((SELECT count(*) FROM lab WHERE lab.verdict = r.verdict) / (SELECT total FROM n)::DOUBLE) > 1.0
    AND NOT EXISTS (SELECT 1 FROM r q WHERE q.verdict = r.verdict AND len(q.t) < len(r.t) AND list_has_all(r.t, q.t) AND q.confidence >= r.confidence)),
p AS (SELECT k.rid, list(DISTINCT first) AS has FROM (SELECT rid, unnest(tokens) AS token FROM k) k JOIN al USING (token) GROUP BY 1),
m AS (
  SELECT rid, (list({'c': confidence, 's': support, 'n': name, 'v': verdict} ORDER BY confidence DESC, support DESC, name DESC, verdict DESC))[1] AS m
  FROM p JOIN g ON list_has_all(p.has, g.t) GROUP BY 1),
j AS (
  SELECT page_id, host, path, m, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN ['example.net/en/', 'allow']
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN ['example.com/de/', 'block']
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN ['org/fr/', 'allow']
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN ['net/', 'block'] END AS fixed
  FROM k LEFT JOIN m USING (rid))
SELECT page_id, host, path, fixed[1] AS rule, coalesce(fixed[2], m.v, 'allow') AS verdict, m.n AS mined FROM j
"""
