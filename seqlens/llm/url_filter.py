"""URL filters: rules first, gradient-boosted trees on lexical features for the rest (operator 13).

The host of a URL is what follows its first `://` up to /, ?, # or the end, with A-Z lower-cased; the path goes on from there up to ?, # or the end. A null URL or one without `://` has an empty host and path.
A rule (verdict, host, path) fits its host and all subdomains of it where the URL's path begins with the rule's; of several the one with the longest host and path together wins, then the longest host, then block.
All other URLs get the verdict of boosted trees, which see how a URL is made and not what it says: lengths, depth, share of digits, entropies, numbers of parameters, hyphens and labels, and of its two host suffixes (the last label, the last two) how many pages and hosts the whole table has under them and the share of blocked ones among the labelled.
The trees learn from labelled URLs: a table (url, label 1 to block or 0) that the caller has, or else `word_labels`, which blocks URLs whose host bears a word of the kinds that public block lists name and allows all others. At most LABELLED URLs of each label are learned from, those first by a hash. Where they hold one label only, nothing is learned and the verdict is allow.

Every row gives one row, repeated rows and ids too; an empty table gives an empty result.

Plan. Suffix counts are grouped before they are shuffled and joined back, a row for each suffix; scoring is a column expression.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Kinds of hosts that public block lists name.
WORDS = ("adult", "ads", "bets", "casino", "malware", "phish", "pills", "poker", "porn", "spam", "track", "warez")
#: The rules of the query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Bound on the labelled URLs of each label that the trees are fitted on.
LABELLED = 5_000
#: Weight of the mean in a suffix's share of blocked URLs, in URLs.
PRIOR = 20.0
SALTS = 32
LEXICAL = ("url_length", "host_length", "path_length", "query_length", "depth", "labels", "longest_label", "digits", "host_digits", "hyphens", "parameters", "url_entropy", "host_entropy", "scheme_secure")
SUFFIX = ("pages_1", "hosts_1", "blocked_1", "pages_2", "hosts_2", "blocked_2")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    return lower_ascii(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The winning rule as a struct (rule, verdict), null if none fits."""
    by_host: dict[str, list] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append(F.struct(F.lit(len(rule_host + rule_path)).alias("n"), F.lit(len(rule_host)).alias("m"), F.lit(verdict).alias("verdict"), F.lit(rule_path).alias("path"), F.lit(rule_host + rule_path).alias("rule")))
    if not by_host:
        return F.lit(None).cast("struct<n:int,m:int,verdict:string,path:string,rule:string>")
    known = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    # only suffixes as long as some rule's host are looked up
    tails = F.array(*[F.when((F.length(host) == n) | (F.substr(host, F.length(host) - n, F.lit(1)) == "."), F.right(host, F.lit(n))) for n in sorted({len(h) for h in by_host})])
    found = F.transform(F.filter(tails, lambda t: t.isNotNull()), lambda t: F.element_at(known, t))
    return F.array_max(F.filter(F.flatten(F.filter(found, lambda f: f.isNotNull())), lambda r: F.startswith(path, r["path"])))


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(c != "", share(c) * F.log2(share(c))).otherwise(0.0))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path, ...) with the LEXICAL features, all doubles."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    share = lambda text, pattern: F.when(F.length(text) > 0, F.regexp_count(text, F.lit(pattern)) / F.length(text)).otherwise(0.0)
    found = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "query_length": F.length(query),
        "depth": F.regexp_count("path", F.lit("/+[^/]")),
        "labels": F.size(F.split("host", r"\.")),
        "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.length)),
        "digits": share(url, "[0-9]"),
        "host_digits": share(F.col("host"), "[0-9]"),
        "hyphens": F.regexp_count("host", F.lit("-")),
        "parameters": F.regexp_count(query, F.lit("[^&=]+=?[^&]*")),
        "url_entropy": entropy(url),
        "host_entropy": entropy(F.col("host")),
        "scheme_secure": F.startswith(url, F.lit("https:")),
    }
    return urls.withColumns({k: v.cast("double") for k, v in found.items()})


def word_labels(pages: DataFrame) -> DataFrame:
    """The distinct URLs with a host, and label: 1 if it bears one of WORDS, else 0."""
    host = host_and_path(F.col("url"))[0]
    return pages.select("url").distinct().select("url", F.rlike(host, F.lit("|".join(WORDS))).cast("int").alias("label")).where(host != "")


def _suffixes(host: Column) -> tuple[Column, Column]:
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    rows = labelled.select(F.coalesce("url", F.lit("")).alias("url"), F.col("label").cast("double").alias("label")).where("label in (0, 1)").distinct().withColumn("h", F.xxhash64("url"))
    first = lambda label: rows.where(F.col("label") == label).orderBy("h", "url").limit(most)
    host, path = host_and_path(F.col("url"))
    return written(first(0.0).unionByName(first(1.0)).select("url", "label", "h", host.alias("host"), path.alias("path")), "labelled")


def suffix_statistics(pages: DataFrame, sample: DataFrame) -> DataFrame:
    """For each host suffix of one or two labels: suffix, pages, hosts (logarithms), blocked (share among the labelled, drawn to one half)."""
    host = host_and_path(F.col("url"))[0]
    kinds = lambda rows, *more: rows.select(F.explode(F.array_distinct(F.array(*_suffixes(F.col("host"))))).alias("suffix"), *more)
    hosts = pages.select(host.alias("host")).groupBy("host").count()
    counts = kinds(hosts, "count").groupBy("suffix").agg(F.log1p(F.sum("count")).alias("pages"), F.log1p(F.count("*")).alias("hosts"))
    blocked = kinds(sample, "label").groupBy("suffix").agg(((F.sum("label") + PRIOR / 2) / (F.count("*") + PRIOR)).alias("blocked"))
    return counts.join(blocked, "suffix", "left").fillna(0.5, ["blocked"])


def _with_suffixes(urls: DataFrame, statistics: DataFrame) -> DataFrame:
    """urls with the SUFFIX features; a suffix of many URLs is dealt over SALTS keys."""
    spread = statistics.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    for i, suffix in enumerate(_suffixes(F.col("host")), 1):
        mine = spread.select(F.col("suffix").alias(f"suffix_{i}"), "salt", *[F.col(c).alias(f"{c}_{i}") for c in ("pages", "hosts", "blocked")])
        urls = urls.withColumn(f"suffix_{i}", suffix).withColumn("salt", F.pmod(F.xxhash64("url", "row"), F.lit(SALTS)).cast("int")).join(mine, [f"suffix_{i}", "salt"], "left")
    return urls.fillna(0.0, ["pages_1", "hosts_1", "pages_2", "hosts_2"]).fillna(0.5, ["blocked_1", "blocked_2"])


def judged(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, most: int = LABELLED) -> DataFrame:
    """Of each row: page_id, host, path, rule, verdict, and probability (of block, by the trees; null where nothing was learned)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    sample = _sample(word_labels(pages) if labelled is None else labelled, most)
    by_rule = [F.col("found.rule").alias("rule"), F.col("found.verdict").alias("by_rule")]
    if sample.select("label").distinct().count() < 2:
        return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("probability"))
    statistics = written(suffix_statistics(pages, sample), "suffixes")
    prepared = lambda urls: VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="features").transform(_with_suffixes(lexical(urls), statistics))
    # the sample is bounded: one partition, in one order, gives the same trees in every run
    train = prepared(sample.withColumn("row", F.lit(0))).select("h", "url", "label", "features").coalesce(1).sortWithinPartitions("h", "url", "label")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxDepth=4, maxIter=20, stepSize=0.2, seed=17).fit(train.cache())
    train.unpersist()
    scored = model.transform(prepared(rows)).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("page_id", "host", "path", *by_rule, "probability").select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "probability")
