"""Secret scans with a random forest that removes false positives (operator 6). DataFrame operations only.

Candidates are taken from inside words (runs without white space), so a secret that is joined to its name, quotes, braces or URL is one too:
runs of 16 characters or more of [A-Za-z0-9+/_.@-] with a digit, = as padding at the end, and their parts between slashes; a word with = in it that has no such run; the password of a URL's user; and what stands after a name such as password or token, of 4 characters or more of any kind: joined by : or =, in the same word or the next ones, or as the next word if that has a digit. There is no longest one. The same text twice in a word is one candidate; a value that has white space ends at it.
Features of a candidate: length, mean log-probability of character transitions and dictionary coverage under the corpus's own words, shares of digits, hexadecimal digits and upper case, distinct characters, separators, the path (the document's source) as a hash class, and the neighbouring words.
The forest learns from labelled findings: (features, label) rows that the caller has, or those of `rule_labels`, which reads a label off candidates whose surroundings or form leave no doubt (an assignment to a name such as token, password or key, a published key prefix; or a mail address, a number that passes Luhn, a dotted quad, a date, a row of one character).
Null, empty and wordless texts have no candidates; every row of the table is its own document, so repeated rows repeat their findings. Without findings of both labels nothing is learned and every candidate is kept with probability null. An empty table gives an empty result.

Plan. Word counts come from all documents, pre-aggregated before the shuffle; only the DICTIONARY most frequent words and the table of character pairs, both of fixed size, reach the driver. The forest is fitted on at most TRAIN labelled findings of each label, those first by a hash.
"""

from __future__ import annotations

import math
import string

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, written
from .fingerprints import let

#: Fewest characters of a candidate, and of one that a name or a URL's user stands before.
SHORTEST, NAMED = 16, 4
DICTIONARY, TRAIN = 2000, 5000
#: Characters of the transition table; all others are its last row and column.
ALPHABET = string.ascii_lowercase + string.digits
NAMES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "private_key")
_NAME = "(?i)(?:token|secret|passw(?:or)?d|passphrase|pass|pwd|key|auth|authorization|bearer|credentials?)"
#: A name that a value is joined to, one at the end of a word with its sign, and one that is a word alone.
_JOINED = _NAME + "[\"'`)\\]]*[:=]+>?"
_ASSIGNS, _ALONE = _JOINED + "$", "^[\"'`(-]*(?:[A-Za-z0-9_.-]*[_.-])?" + _NAME + "[\"'`)\\]]*$"
_VALUE = "(\"[^\"]+\"|'[^']+'|`[^`]+`|[\"'`]?[^\"'`]+)"
_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|eyJ)"
_MAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"
#: What the forest sees. The name that a candidate is assigned to (`named`, `assigned`) is for rule_labels: a forest that saw what its labels came from would learn nothing else.
FEATURES = ("length", "transitions", "coverage", "digits", "hex", "upper", "distinct", "separators", "path_class", "before_length", "before_known", "after_known")


def _unquoted(value: Column) -> Column:
    """A value as it stands after its name: what is between its quotes; without quotes, up to the next name of a list or query, and without end punctuation."""
    bare = F.rtrim(F.regexp_replace(F.ltrim(value, F.lit("\"'`")), "[&,;][A-Za-z0-9_.%-]+[:=].*$", ""), F.lit(",;.)}]>\\"))
    return F.when(value.rlike("^([\"'`]).*\\1$"), value.substr(F.lit(2), F.length(value) - 2)).otherwise(bare)


def _inside(word: Column, named: Column) -> Column:
    """The candidates in a word; named: whether a name stands before the word."""
    long = lambda a: F.filter(F.transform(a, lambda c: F.rtrim(c, F.lit("."))), lambda c: (F.length(c) >= SHORTEST) & c.rlike("[0-9]"))
    every = lambda pattern: F.regexp_extract_all(word, F.lit(f"({pattern})"), F.lit(1))
    least = lambda a: F.filter(a, lambda c: F.length(c) >= NAMED)
    runs = long(F.concat(every(f"[A-Za-z0-9+/_.@-]{{{SHORTEST},}}={{0,2}}"), every(f"[A-Za-z0-9+_.@-]{{{SHORTEST},}}={{0,2}}")))
    ends = F.rtrim(F.ltrim(word, F.lit("\"'`(<[")), F.lit("\"'`)>],;:!?.#$%&*|"))
    whole = F.filter(F.array(ends), lambda c: (F.length(c) >= SHORTEST) & c.rlike("^[A-Za-z0-9+/=_.@-]+$") & c.rlike("[0-9]"))
    after = F.when(named, F.array(F.regexp_extract(word, f"^{_VALUE}", 1))).otherwise(F.array().cast("array<string>"))
    values = least(F.transform(F.concat(F.regexp_extract_all(word, F.lit(_JOINED + _VALUE), F.lit(1)), after), _unquoted))
    users = least(F.regexp_extract_all(word, F.lit("://[^/?#:@\"'`]*:([^/?#\"'`]+)@"), F.lit(1)))
    return let(F.array_distinct(F.concat(runs, values, users)), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, nth (word in its text), candidate, quoted, and what stands around: before2, before, after (words, before also the name in the same word)."""
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")

    def named(w: Column, i: Column, x: Column) -> Column:
        last, last_but_one = F.get(w, i - 1), F.get(w, i - 2)
        by_sign = last.rlike(_ASSIGNS) | (last.rlike("^[:=]+>?$") & last_but_one.rlike(_NAME + "[\"'`)\\]]*$"))
        return F.coalesce(by_sign | (last.rlike(_ALONE) & x.rlike("[0-9]")), F.lit(False))

    def spot(w: Column) -> Column:
        each = F.transform(w, lambda x, i: F.struct(i.alias("i"), x.alias("x"), (F.when(F.length(x) >= NAMED, named(w, i, x)).otherwise(False)).alias("named")))
        return F.filter(each, lambda s: s["named"] | ((F.length(s["x"]) >= SHORTEST) & s["x"].rlike("[0-9]")) | s["x"].rlike(_JOINED) | s["x"].rlike("://[^/?#@]*:[^/?#]*@"))

    def around(w: Column, s: Column, c: Column) -> Column:
        ahead = F.rtrim(F.substring(F.call_function("substring_index", s["x"], c, F.lit(1)), -100, 100), F.lit("\"'`(<["))
        inner = F.regexp_extract(ahead, "[A-Za-z0-9_.-]*[\"'`)\\]]*[^A-Za-z0-9_.\"'`)\\]-]*$", 0)
        joined = inner != ""
        return F.struct(s["i"].alias("nth"), c.alias("candidate"), s["x"].rlike("^[\"'`]").alias("quoted"), F.when(joined, F.get(w, s["i"] - 1)).otherwise(F.get(w, s["i"] - 2)).alias("before2"), F.when(joined, inner).otherwise(F.get(w, s["i"] - 1)).alias("before"), F.get(w, s["i"] + 1).alias("after"))

    each = lambda w: F.flatten(F.transform(spot(w), lambda s: F.transform(_inside(s["x"], s["named"]), lambda c: around(w, s, c))))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text").where((F.col("text").rlike("[0-9]") & F.col("text").rlike(f"[^\\x20\\x09-\\x0D]{{{SHORTEST}}}")) | F.col("text").rlike(_NAME) | F.col("text").rlike("://[^/?#@]*:"))
    return some.select("doc_id", "path", F.explode(let(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), each)).alias("x")).select("doc_id", "path", "x.*")


def corpus_statistics(docs: DataFrame, words: int = DICTIONARY) -> tuple[list[str], list[float]]:
    """The most frequent words of letters, and the log-probability of each pair of ALPHABET characters (row by row, the last of each for any other), both over all documents."""
    counted = written(docs.select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")), "words")
    top = [r[0] for r in counted.where(F.length("word") >= 2).orderBy(F.desc("n"), "word").limit(words).collect()]
    steps = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.concat(a, b))
    pairs = counted.where("length(word) >= 2").select("n", F.explode(let(F.split("word", ""), steps)).alias("pair"))
    seen = dict(pairs.groupBy("pair").agg(F.sum("n")).collect())  # at most 36 * 36 rows
    size, table = len(ALPHABET) + 1, []
    for a in [*ALPHABET, ""]:
        row = [seen.get(a + b, 0) + 1 if a and b else 1 for b in [*ALPHABET, ""]]
        table += [math.log(n / sum(row)) for n in row]
    assert len(table) == size * size
    return top, table


def features(found: DataFrame, top: list[str], table: list[float]) -> DataFrame:
    """found with the columns of FEATURES, and named and assigned."""
    low = F.lower("candidate")
    logs = F.array(*map(F.lit, table))
    # a candidate has no upper length: one pass over its characters
    steps = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(logs, a * (len(ALPHABET) + 1) + b))
    spelled = let(F.transform(F.split(low, ""), _code), steps)
    parts = F.filter(F.split(low, "[^a-z]+"), lambda p: F.length(p) >= 2)
    known = F.array(*map(F.lit, top)) if top else F.array().cast("array<string>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    share = lambda pattern: F.length(F.regexp_replace("candidate", pattern, "")) / F.length("candidate")
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9_]", "")
    name = F.when(bare(F.col("before")) == "", bare(F.col("before2"))).otherwise(bare(F.col("before")))
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.withColumns({
        "length": F.length("candidate").cast("double"),
        "transitions": total(spelled) / F.greatest(F.size(spelled), F.lit(1)),
        "coverage": total(F.transform(F.array_intersect(parts, known), lambda p: F.length(p).cast("double"))) / F.length("candidate"),
        "digits": share("[^0-9]"),
        "hex": share("[^0-9a-f]"),
        "upper": share("[^A-Z]"),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))).cast("double"),
        "separators": share("[A-Za-z0-9]"),
        "path_class": F.pmod(F.xxhash64("path"), F.lit(16)).cast("double"),
        "named": name.isin(*NAMES).cast("double"),
        "assigned": as_int(F.col("before").rlike("[=:]$")),
        "before_length": F.coalesce(F.length("before"), F.lit(0)).cast("double"),
        "before_known": F.array_contains(known, bare(F.col("before"))).cast("double"),
        "after_known": F.array_contains(known, bare(F.col("after"))).cast("double"),
    })


def _code(char: Column) -> Column:
    """A character's place in ALPHABET, its length for any other."""
    place = F.position(char, F.lit(ALPHABET))
    return F.when(place > 0, place - 1).otherwise(F.lit(len(ALPHABET)))


def _luhn(text: Column) -> Column:
    """Whether a string of 13 to 19 digits passes Luhn's check."""
    odd = lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    digits = F.transform(F.split(F.reverse(text), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    return text.rlike("^[0-9]{13,19}$") & (F.aggregate(F.transform(digits, odd), F.lit(0), lambda a, b: a + b) % 10 == 0)


def rule_labels(found: DataFrame) -> DataFrame:
    """Candidates whose surroundings or form tell a label (1: a secret, 0: not), with that label."""
    word = F.col("candidate")
    # no mail address is longer
    against = F.when(F.length(word) <= 320, word.rlike(_MAIL)).otherwise(False) | _luhn(word) | word.rlike(r"^[0-9]+(\.[0-9]+){3}$") | word.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") | word.rlike(r"^(.)\1+$") | (F.col("coverage") > 0.6)
    label = F.when(against, 0).when(word.rlike(_PREFIX) | ((F.col("named") == 1) & (F.col("coverage") < 0.3) & word.rlike("[0-9]") & ((F.length(word) >= SHORTEST) | word.rlike("[A-Za-z]"))), 1)
    return found.withColumn("label", label.cast("double")).where("label is not null")


def fit(labelled: DataFrame, most: int = TRAIN):
    """A fitted forest, or None without findings of both labels."""
    rows = labelled.select("label", "candidate", "doc_id", "nth", *FEATURES).withColumn("h", F.xxhash64("candidate", "doc_id", "nth"))
    first = lambda label: rows.where(F.col("label") == label).orderBy("h", "candidate").limit(most)
    sample = written(first(0.0).unionByName(first(1.0)), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=20, maxDepth=6, seed=17)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(sample)


def secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """All candidates: doc_id, nth (word of the text, from 0), candidate, probability, is_secret. labelled: rows of FEATURES, label, candidate, doc_id and nth; without it rule_labels are learned from."""
    top, table = corpus_statistics(docs)
    found = written(features(candidates(docs), top, table), "candidates")
    model = fit(rule_labels(found) if labelled is None else labelled)
    if model is None:
        return found.select("doc_id", "nth", "candidate", F.lit(None).cast("double").alias("probability"), F.lit(True).alias("is_secret"))
    scored = model.transform(found).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "nth", "candidate", "probability", (F.col("probability") >= 0.5).alias("is_secret"))
