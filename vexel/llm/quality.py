"""Quality classifier: document evidence combined with host and path posteriors, by hierarchical empirical Bayes.

A logistic model on text statistics, fitted on labelled documents, gives each document a probability. Over all
documents, probabilities are summed by path and host. A host's posterior shrinks its mean toward the global mean, a path's
toward its host's, each with a strength that the spread between groups gives (method of moments), so that sparse sites
say little. A document's final log-odds are the model's plus what its path, the document left out, differs from the whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import join_groups, n_words, written

#: Labelled documents that the model is fitted on, at most: those with the least hashes of their ids.
FIT_ROWS = 20_000
#: Strengths are kept in this range of pseudo-documents.
STRENGTH = (1.0, 10_000.0)
RIDGE = 1e-3
KEEP = 0.5

FEATURES = ("symbols", "marks", "capitals", "repeats", "bars", "digits", "word_length", "log_words", "any_symbols", "any_repeats", "any_bars", "any_capitals")


def features(text: Column) -> list[Column]:
    """Statistics of the whole text; a null counts as empty, of which all are 0."""
    text = F.coalesce(text, F.lit(""))
    chars, words = F.greatest(F.char_length(text), F.lit(1)), F.greatest(n_words(text), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    symbols, marks = count(r"[#%$*&@^~=<>]{2,}"), count(r"[!?]{2,}")
    capitals, bars = count(r"(?<![\p{L}])\p{Lu}{2,}"), count(r"(?<=\s)\|(?=\s)")
    repeats = count(r"(?<!\S)(\S+)\s+\1(?!\S)")
    return [symbols / words, marks / words, capitals / words, repeats / words, bars / words, count(r"\d") / chars, F.char_length(text) / words / 10, F.log1p(n_words(text)) / 10, (symbols >= 3).cast("double"), (repeats >= 3).cast("double"), (bars >= 3).cast("double"), (capitals >= 5).cast("double")]


def fit(measured: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> np.ndarray:
    """Intercept and weights, by Newton's method with a small ridge, from at most `rows` labelled documents.

    Labels that are null, documents without an id or label, and repeats of an id's label beyond the greatest don't
    count. With one class only, or none, the weights are 0 and the intercept is that class's share, or even odds.
    """
    own = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.max("quality") > 0).cast("double").alias("y"))
    picked = measured.where("doc_id is not null").join(own, measured["doc_id"] == own["_id"]).select(F.xxhash64("doc_id", F.lit(3)).alias("h"), "y", "x").orderBy("h", "x").limit(rows).toArrow()
    y = picked.column("y").to_numpy()
    beta = np.zeros(len(FEATURES) + 1)
    if len(y) == 0 or y.min() == y.max():
        beta[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return beta
    x = np.c_[np.ones(len(y)), np.array(picked.column("x").to_pylist())]
    ridge = np.diag([0.0] + [RIDGE * len(y)] * len(FEATURES))
    scale = np.r_[1.0, np.maximum(x[:, 1:].std(axis=0), 1e-6)]
    x = x / scale
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(beta)), x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta / scale


def _logit(p):
    return F.log(p / (1 - p))


def posteriors(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """One row for each path, host, path, host_k, host_n, path_k, path_n (sums of p and rows), and the priors.

    The priors are the global mean `base` and the strengths, in pseudo-documents, of a host's prior and of a path's.
    """
    paths = written(scored.groupBy("host", "path").agg(F.sum("p").alias("path_k"), F.count(F.lit(1)).alias("path_n")))
    hosts = written(paths.groupBy("host").agg(F.sum("path_k").alias("host_k"), F.sum("path_n").alias("host_n")))
    total = hosts.agg(F.sum("host_k").alias("k"), F.sum("host_n").alias("n")).first()
    base = min(max((total.k or 0.0) / (total.n or 1), 1e-4), 1 - 1e-4)

    def strength(groups, name, mean):
        """How little group means vary beyond what their sizes let expect."""
        k, n = F.col(f"{name}_k"), F.col(f"{name}_n")
        got = groups.agg(F.sum(n * (k / n - mean) ** 2).alias("s"), F.sum(n).alias("n"), F.sum(n**2).alias("nn"), F.count(F.lit(1)).alias("g")).first()
        if not got.g or got.g < 2:
            return STRENGTH[1]
        noise, room = base * (1 - base), got.n - got.nn / got.n
        between = ((got.s or 0.0) - (got.g - 1) * noise) / room if room > 0 else 0.0
        return float(np.clip(noise / between - 1 if between > 0 else STRENGTH[1], *STRENGTH))

    both = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return both, {"base": base, "host": strength(hosts, "host", F.lit(base)), "path": strength(both, "path", F.col("host_k") / F.col("host_n"))}


def classify(docs: DataFrame, labels: DataFrame, text_col: str = "text", host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", keep: float = KEEP, carry: tuple[str, ...] | None = None) -> DataFrame:
    """docs' columns (or those in `carry`), with doc_score, host_posterior, path_posterior, quality and keep; as `documents` has no urls, a host is its source and a path its language there.

    doc_score is the model's probability of good quality, quality the one after host and path have their say, keep
    whether that is at least `keep`. The posteriors are those of a document's host and path without the document itself,
    so that its evidence counts once. Null hosts and paths are groups of their own; a null or empty text has all statistics
    0. Repeated rows are rows of their own. An empty table gives an empty result. Own columns named like the new ones are
    replaced, all others come through whatever their names.
    """
    made = ("doc_score", "host_posterior", "path_posterior", "quality", "keep")
    own = [c for c in carry or docs.columns if c not in made]
    inner = [f"_c{k}" for k in range(len(own))]
    x = F.array(*[f.cast("double") for f in features(F.col(text_col))]).alias("x")
    host, path = F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path")
    # narrow rows: the statistics are taken once for fitting and sums
    kept = written(docs.select(F.col(id_col).alias("doc_id"), host, path, x))
    beta = fit(kept, labels)

    def odds(values):
        out = F.lit(float(beta[0]))
        for k, b in enumerate(beta[1:]):
            out = out + values[k] * float(b)
        return out

    chance = lambda z: 1 / (1 + F.exp(-z))
    sites, prior = posteriors(kept.select("host", "path", chance(odds(F.col("x"))).alias("p")))
    sites = written(sites.withColumnsRenamed({"host": "_host", "path": "_path"}))
    wide = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own, inner, strict=True)], F.col(id_col).cast("string").alias("_id"), x, host, path)
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    placed = join_groups(wide, sites, same, F.xxhash64("_id", "x"))
    scored = placed.withColumn("_z", odds(F.col("x"))).withColumn("doc_score", chance(F.col("_z")))
    without = lambda k, n, m, mean: (F.greatest(F.col(k) - F.col("doc_score"), F.lit(0.0)) + m * mean) / (F.col(n) - 1 + m)
    scored = scored.withColumn("host_posterior", without("host_k", "host_n", prior["host"], F.lit(prior["base"])))
    scored = scored.withColumn("path_posterior", without("path_k", "path_n", prior["path"], F.col("host_posterior")))
    scored = scored.withColumn("quality", chance(F.col("_z") + _logit(F.col("path_posterior")) - _logit(F.lit(prior["base"]))))
    return scored.withColumn("keep", F.col("quality") >= keep).select(*[F.col(n).alias(c) for c, n in zip(own, inner, strict=True)], *made)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels, carry=("doc_id", "source", "lang"))
