"""Quality by hierarchical empirical Bayes over sites.

A document classifier (logistic regression on counts of characters, repeats and word
shapes) gives each document its log odds. Grouped sums of the probabilities over every
path and host, shrunk level by level, say how good a site is: a path towards its
host, a host towards the whole corpus. How far is itself learned from the corpus, by
the spread between the groups (moments of a beta-binomial): sparse sites fall back
on the level above, large ones speak for themselves. A document's posterior adds its
path's log odds, beyond the corpus', to its own.

The classifier is trained on at most TRAIN_DOCS labelled rows of either class, of at
most TRAIN_CHARS characters; everything else covers all rows and whole texts.

Defined cases: null and empty texts have the classifier's value for no characters;
null hosts and paths are groups of their own; repeated rows count as often as they
come; ids are only carried; without both labels the classifier says nothing (log odds 0)
and every document is kept.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import by_position, columns, documents, hot_keys, small_batches, split_join, staged, texts_of
from tallyfold.llm.toxicity import _logistic, held_out

TRAIN_DOCS, TRAIN_CHARS = 2000, 20_000
#: Characters that every text is thought to have more, none of them a mark.
SHORT = 64
#: Documents of at least this posterior stay.
KEEP = 0.5
#: A document's own log odds stay within this: no site outweighs plain evidence, nor the other way.
ODDS_LIMIT = 8.0
#: What a site can add to the log odds at most.
SITE_LIMIT = 2.0
#: Paths whose values are broadcast: a digest and a number each, some 60 MB.
SITES_IN_MEMORY = 500_000
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]


def evidence_row(text: str) -> np.ndarray:
    """Shares of characters and words of one whole text, on a logarithmic scale."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(raw) + SHORT  # a few marks in a short text are no evidence
    h = np.bincount(raw, minlength=256)
    letters = h[65:91].sum() + h[97:123].sum() + h[128:].sum() + SHORT
    mark = np.zeros(256, dtype=bool)
    mark[_PUNCT] = True
    doubled = int(((raw[1:] == raw[:-1]) & mark[raw[1:]]).sum()) if len(raw) > 1 else 0
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    k = len(words) + SHORT / 4
    shares = [
        *(h[c] / n for c in _PUNCT), h[48:58].sum() / n, h[128:].sum() / n, h[65:91].sum() / letters, doubled / n, h[32] / n, h[10] / n,
        sum(map(operator.eq, words, words[1:])) / k, (len(lines) - len(set(lines))) / (len(lines) + 8),
    ]
    return np.array([1.0, *np.log1p(100 * np.array(shares, dtype=np.float64)), math.log1p(len(raw) / k)])


class Classifier:
    """Standardised logistic regression."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def log_odds(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = (np.stack([evidence_row(t) for t in texts]) - self.mean) / self.scale
        return np.clip(x @ self.weights, -ODDS_LIMIT, ODDS_LIMIT)


def train_classifier(good: list[str], bad: list[str]) -> Classifier | None:
    if not good or not bad:
        return None
    x = np.stack([evidence_row(t) for t in [*good, *bad]])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[0], scale[0] = 0, 1
    y = np.array([1.0] * len(good) + [0.0] * len(bad))
    return Classifier(mean, scale, _logistic((x - mean) / scale, y, ridge=2e-3))


def training_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[str]]:
    """(good, bad) texts: the labelled rows not held out with the smallest id hashes."""
    known = columns(labels, id=id_col, y=label_col).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).dropDuplicates(["id"])
    pick = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS) for y in (1, 0)]
    ids = pick[0].unionByName(pick[1])  # at most 2 TRAIN_DOCS rows
    texts = columns(docs, id=id_col, text=text_col).filter(F.length("text") <= TRAIN_CHARS)
    rows = texts.join(F.broadcast(ids), "id").dropDuplicates(["id"]).orderBy("id").collect()
    return [r.text for r in rows if r.y == 1], [r.text for r in rows if r.y == 0]


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def prior_strength(mean: float, groups: int, n: float, n_sq: float, spread: float) -> float:
    """Rows that a level's mean counts for, by moments.

    ``spread``: sum over groups of n (group mean - mean)^2. Groups that differ no more
    than chance would let them give a very strong prior.
    """
    if groups < 2 or not 0 < mean < 1:
        return 1e9
    within = mean * (1 - mean)
    effective = (n - n_sq / n) / (groups - 1)
    between = (spread / (groups - 1) - within) / max(effective, 1e-9)
    return min(1e9, max(1.0, within / between - 1)) if between > 0 else 1e9


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """``host, path, site`` (posterior mean) and ``n`` (rows) per path, and the corpus mean.

    ``scored``: host, path, p. Sums per path are combined before their shuffle, so a
    host with a third of all rows is a handful of partial sums; only totals of
    the two levels reach the driver.
    """
    paths = staged(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "path-sums")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total.n:
        return paths.select("host", "path", F.lit(0.5).alias("site"), "n"), 0.5
    mean = total.s / total.n

    def strength(groups: DataFrame, centre: Column) -> float:
        m = F.col("s") / F.col("n")
        r = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"), F.sum(F.col("n") * (m - centre) ** 2).alias("v")).first()
        return prior_strength(mean, r.g, float(r.n), float(r.n2), float(r.v))

    k_host = strength(hosts, F.lit(mean))
    hosts = hosts.select("host", ((F.col("s") + k_host * mean) / (F.col("n") + k_host)).alias("host_mean"))
    with_host = paths.join(hosts, "host")
    k_path = strength(with_host, F.col("host_mean"))
    site = (F.col("s") + k_path * F.col("host_mean")) / (F.col("n") + k_path)
    return with_host.select("host", "path", site.alias("site"), "n"), mean


def log_odds(docs: DataFrame, model: Classifier | None, *, text_col: str, out: str) -> DataFrame:
    """``docs`` with the classifier's log odds as one more column."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = texts_of(b.column(at))
            v = np.zeros(len(texts)) if shared.value is None else shared.value.log_odds(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, pa.float64())], [*b.schema.names, out])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out, DoubleType()))


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality"):
    """(classifier, site posteriors, corpus mean) of a corpus."""
    model = train_classifier(*training_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    rows = columns(docs, text=text_col, host=host_col, path=path_col)
    # Only the sums per path leave this pass, never the texts.
    scored = log_odds(rows.select("text", _key(F.col("host")).alias("host"), _key(F.col("path")).alias("path")), model, text_col="text", out="odds")
    sites, mean = site_posteriors(scored.select("host", "path", (1 / (1 + F.exp(-F.col("odds")))).alias("p")))
    return model, staged(sites, "sites"), mean


def _site_key(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path).cast("binary"), 256)


def with_site(rows: DataFrame, host: Column, path: Column, sites: DataFrame, in_memory: int = SITES_IN_MEMORY) -> DataFrame:
    """``rows`` with the value of their path as ``__site``.

    Few paths are broadcast, so no text is shuffled. Of more, a path that holds many rows is dealt to parts.
    """
    values = sites.select(_site_key(F.col("host"), F.col("path")).alias("__key"), F.col("site").alias("__site"), F.col("n").alias("__n"))
    known = values.agg(F.count(F.lit(1)).alias("paths"), F.coalesce(F.sum("__n"), F.lit(0)).alias("rows")).first()
    keyed = rows.withColumn("__key", _site_key(host, path))
    if known.paths <= in_memory:
        return keyed.join(F.broadcast(values.drop("__n")), "__key", "left").drop("__key")
    hot = staged(hot_keys(values, "__key", "__n", known.rows), "hot-paths")
    return split_join(keyed, values.drop("__n"), ["__key"], F.monotonically_increasing_id(), hot, "left").drop("__key")


def _posterior(odds: Column, site: Column, mean: float) -> Column:
    shift = _logit(site) - _logit(F.lit(mean))
    return 1 / (1 + F.exp(-(odds + F.greatest(F.least(shift, F.lit(SITE_LIMIT)), F.lit(-SITE_LIMIT)))))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """``doc_id, classifier, site, quality, kept`` for every row."""
    model, sites, mean = fitted(docs, labels, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col, label_col=label_col)
    rows = columns(docs, doc_id=id_col, text=text_col, host=host_col, path=path_col)
    rows = rows.select("doc_id", "text", _key(F.col("host")).alias("host"), _key(F.col("path")).alias("path"))
    scored = log_odds(rows, model, text_col="text", out="odds").drop("text")
    q = _posterior(F.col("odds"), F.col("__site"), mean)
    out = with_site(scored, F.col("host"), F.col("path"), sites)
    return out.select("doc_id", (1 / (1 + F.exp(-F.col("odds")))).alias("classifier"), F.col("__site").alias("site"), q.alias("quality"), (q >= KEEP).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """``docs`` without the rows that :func:`quality` rejects; all columns stay."""
    model, sites, mean = fitted(docs, labels, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col, label_col=label_col)
    rows, where = by_position(docs)
    scored = log_odds(rows, model, text_col=where[text_col], out="__odds")
    placed = with_site(scored, _key(F.col(where[host_col])), _key(F.col(where[path_col])), sites)
    kept = placed.filter(_posterior(F.col("__odds"), F.col("__site"), mean) >= KEEP)
    return kept.select(*rows.columns).toDF(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its host is the source, its path the language section."""
    return quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
