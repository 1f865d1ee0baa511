"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

DataFrame and SQL functions and Spark ML only; no Python runs on an executor.
The trees are trained on a bounded sample of labelled URLs (``TRAIN_ROWS``,
the rows with the smallest hashes, so the sample is the same on every run);
suffix statistics are counted over all labelled URLs. A URL that is trained on
gets its suffix's statistics from the other folds only (all URLs of a host are
in one), so its own label is not among its features. Every split chooses from a
third of the features, so no feature that alone tells the training labels apart
carries the trees alone. ``UrlModel.report`` gives the importances and the
accuracy and ROC area on hosts held out. Every URL is judged.

Labelled URLs are an input (``url, bad``). Where a corpus has none,
``label_by_words`` labels URLs by words of the host's parts, as a start: the
trees then learn from length, depth, digits, entropy, parameters and suffixes
what such URLs look like.

Defined cases: a null URL or one without ``://`` has empty host and path, fits
no rule, and is judged on its (empty) features; without labelled URLs of both
kinds there is nothing to learn and every URL gets the labels' own verdict
(allow if there are none); a score at the threshold blocks; repeated rows are
judged alike; a very long URL is judged whole (its entropy takes a pass per
distinct character); an empty table gives no rows; extra columns are ignored
unless carried.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.llm.runtime import prepare, staged

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK_WORDS = ("adult", "bets", "casino", "pills", "spam", "track")
TRAIN_ROWS = 20_000
THRESHOLD = 0.5
FOLDS = 5
SMOOTH = 10.0                  # rows of the overall rate that a suffix's rate is mixed with
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as ``struct(rule, verdict)``; null if none does."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):     # a longer one replaces a shorter
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _share(text: Column, pattern: str) -> Column:
    kept = F.length(F.regexp_replace(text, pattern, ""))
    return F.coalesce((F.length(text) - kept) / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def _count(text: Column, sign: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    n = F.length(text)
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))

    def add(total, c):
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return total - p * F.log2(p)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(letters, F.lit(0.0), add))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of ``url, host, path``: columns ``f_*`` and ``suffix``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    return df.withColumns({
        "f_length": F.length(url).cast("double"), "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"), "f_depth": F.size(parts).cast("double"),
        "f_labels": F.when(F.col("host") == "", 0.0).otherwise(_count(F.col("host"), ".") + 1),
        "f_hyphens": _count(F.col("host"), "-"), "f_digits": _share(url, "[0-9]"),
        "f_host_digits": _share(F.col("host"), "[0-9]"), "f_host_entropy": _entropy(F.col("host")),
        "f_path_entropy": _entropy(F.col("path")),
        "f_parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "f_secure": url.startswith("https:").cast("double"), "f_fragment": url.contains("#").cast("double"),
        "suffix": F.substring_index("host", ".", -2)})


FEATURES = ("f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_hyphens", "f_digits",
            "f_host_digits", "f_host_entropy", "f_path_entropy", "f_parameters", "f_secure", "f_fragment",
            "f_suffix_bad", "f_suffix_rows")


def label_by_words(urls: DataFrame, words: tuple[str, ...] = BLOCK_WORDS) -> DataFrame:
    """``url, bad``: whether a part of the host (split at dots and hyphens) is one of ``words``."""
    parts = F.split(host_of(F.col("url")), "[.-]")
    return urls.select("url", F.arrays_overlap(parts, F.array(*map(F.lit, words))).alias("bad"))


def _fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), host), F.lit(FOLDS)).cast("int")


class UrlModel:
    """Trees and suffix statistics; ``score`` adds the probability that a URL is bad."""

    def __init__(self, labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 5):
        known = (labelled.filter("bad IS NOT NULL").select("url", F.col("bad").cast("int").cast("double").alias("bad"))
                 .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}))
        known = lexical(known).withColumn("fold", _fold(F.col("host")))
        self.all = known.agg(F.coalesce(F.avg("bad"), F.lit(0.0))).first()[0]
        self.by_fold = staged(known.groupBy("suffix", "fold").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")))
        self.suffixes = staged(self.by_fold.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")))
        self.model = None
        if not 0.0 < self.all < 1.0:
            return
        # both kinds in equal number, as far as there are; ordered by a hash and the URL
        def some(kind: int) -> DataFrame:
            return known.filter(F.col("bad") == kind).orderBy(F.xxhash64("url"), "url").limit(rows // 2)
        self.train = staged(self._features(some(0).unionByName(some(1)), out_of_fold=True))
        self.trees = GBTClassifier(featuresCol="features", labelCol="bad", maxIter=trees, maxDepth=depth, maxBins=32,
                                   featureSubsetStrategy="onethird", seed=7, cacheNodeIds=False)
        self.model = self.trees.fit(self.train)

    def _features(self, df: DataFrame, out_of_fold: bool = False) -> DataFrame:
        """The feature vector; ``out_of_fold``: with the statistics of a suffix's other folds, for rows that are learnt from."""
        stats = self.suffixes.select(F.col("suffix").alias("of"), F.col("bad").alias("bad_here"), "n")
        df = df.join(stats, F.col("suffix") == F.col("of"), "left")
        bad, n = F.coalesce("bad_here", F.lit(0.0)), F.coalesce("n", F.lit(0))
        if out_of_fold:
            own = self.by_fold.select(F.col("suffix").alias("of_own"), F.col("fold").alias("fold_own"), F.col("bad").alias("bad_own"),
                                      F.col("n").alias("n_own"))
            df = df.join(own, (F.col("suffix") == F.col("of_own")) & (F.col("fold") == F.col("fold_own")), "left")
            bad, n = bad - F.coalesce("bad_own", F.lit(0.0)), n - F.coalesce("n_own", F.lit(0))
        df = df.withColumns({"f_suffix_bad": (bad + SMOOTH * self.all) / (n + SMOOTH), "f_suffix_rows": F.log1p(n.cast("double"))})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
            df.drop("of", "bad_here", "n", "of_own", "fold_own", "bad_own", "n_own"))

    def report(self) -> dict:
        """``importance`` per feature of the fitted trees; ``accuracy`` and ``roc_area`` of trees that were fitted without the
        last fold of the training rows, on that fold."""
        if self.model is None:
            return {"importance": {}, "accuracy": None, "roc_area": None}
        held = self.train.filter(F.col("fold") == FOLDS - 1)
        if held.select("bad").distinct().count() < 2:
            return {"importance": dict(zip(FEATURES, self.model.featureImportances.toArray().tolist())), "accuracy": None, "roc_area": None}
        scored = self.trees.fit(self.train.filter(F.col("fold") < FOLDS - 1)).transform(held)
        area = BinaryClassificationEvaluator(labelCol="bad", rawPredictionCol="rawPrediction").evaluate(scored)
        right = scored.agg(F.avg((F.col("prediction") == F.col("bad")).cast("double"))).first()[0]
        return {"importance": dict(zip(FEATURES, self.model.featureImportances.toArray().tolist())), "accuracy": right, "roc_area": area}

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` has ``url, host, path``; adds ``bad_score``."""
        if self.model is None:
            return df.withColumn("bad_score", F.lit(float(self.all)))
        scored = self.model.transform(self._features(lexical(df)))
        return scored.withColumn("bad_score", vector_to_array("probability")[1]).drop(
            *FEATURES, "suffix", "features", "rawPrediction", "probability", "prediction")


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, *carry, url, host, path, rule, bad_score, verdict``, a row per input row."""
    if clash := ({"page_id", "url", "host", "path", "rule", "bad_score", "verdict", "suffix", *FEATURES,
                  "features", "rawPrediction", "probability", "prediction", "of", "bad_here", "n", "found"} & set(carry)):
        raise ValueError(f"carried columns clash with result columns: {sorted(clash)}")
    prepare(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), *carry) \
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    scored = UrlModel(labelled).score(source).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bad_score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", *carry, "url", "host", "path", F.col("found.rule").alias("rule"), "bad_score",
                         F.coalesce("found.verdict", own).alias("verdict"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("page_id", "host", "path", "rule", "verdict")
