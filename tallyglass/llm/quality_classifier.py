"""Quality classifier: regularised quadratic discriminant over transformed statistics of the text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import BLANKS, let, whole_text, words_of
from tallyglass.llm.quality_rules import repeated_words

STATISTICS = ("chars", "words", "word_length", "symbols", "capitals", "digits", "stops", "distinct", "repeats", "pairs",
              "short", "lines", "spread")


def _kept(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` are left when all matches of ``pattern`` are gone."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("double")


def statistics(text: Column) -> Column:
    """An array of doubles by ``STATISTICS``: logarithms of sizes and square roots of shares, which spread them evenly.

    An empty text has only zeros.
    """
    def share(part: Column, whole: Column) -> Column:
        return F.sqrt(part / F.greatest(whole, F.lit(1.0)))

    def of_words(words: Column) -> Column:
        n = F.size(words).cast("double")
        twins = F.size(F.filter(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False)))).cast("double")
        short = F.size(F.filter(words, lambda w: F.length(w) == 1)).cast("double")
        lengths = F.transform(words, lambda w: F.length(w).cast("double"))
        squares = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x * x)
        return F.array(n, F.size(F.array_distinct(words)).cast("double"), repeated_words(words).cast("double"), twins, short, squares)

    def all_of(w: Column) -> Column:
        n, chars = w[0], F.length(text).cast("double")
        bare = _kept(text, BLANKS)
        mean = bare / F.greatest(n, F.lit(1.0))
        deviation = F.sqrt(F.greatest(w[5] / F.greatest(n, F.lit(1.0)) - mean * mean, F.lit(0.0)))
        lines = F.when(n > 0, F.size(F.split(text, "\n"))).otherwise(0).cast("double")
        return F.array(
            F.log1p(chars), F.log1p(n), F.log1p(mean), share(_kept(text, r"[^#*$%&|<>{}=_~^\\]+"), chars),
            share(_kept(text, r"[^\p{Lu}]+"), chars), share(_kept(text, "[^0-9]+"), chars), share(_kept(text, "[^.,;:!?]+"), chars),
            share(w[1], n), share(w[2], n), share(w[3], n), share(w[4], n), F.log1p(lines), F.log1p(deviation))

    return let(let(words_of(text), of_words), all_of)


@dataclass
class Discriminant:
    """Per class: log of its share, mean, inverse Cholesky factor of its covariance and the factor's log determinant."""

    shares: list[float]
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    logs: list[float]

    @classmethod
    def fit(cls, sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float = 0.1) -> "Discriminant | float":
        """From each class's count, sums and sums of products.

        A class covariance is drawn by ``shrinkage`` towards the pooled one, and that towards its diagonal, and both keep
        a floor, so that constant statistics and small classes leave it invertible.  With one class or none there is no
        boundary to learn: the result is that class's label, or 1/2.
        """
        if len(sums) < 2:
            return float(next(iter(sums), 0.5))
        total = sum(n for n, _, _ in sums.values())
        moments = {}
        for label, (n, linear, square) in sums.items():
            mean = linear / n
            moments[label] = mean, square / n - np.outer(mean, mean)
        pooled = sum(sums[label][0] * cov for label, (_, cov) in moments.items()) / total
        floor = np.diag(np.diag(pooled) * 1e-2 + 1e-4)
        target = (1 - shrinkage) * pooled + shrinkage * np.diag(np.diag(pooled))
        out = cls([], [], [], [])
        for label in (0, 1):
            mean, cov = moments[label]
            lower = np.linalg.cholesky((1 - shrinkage) * cov + shrinkage * target + floor)
            out.shares.append(float(np.log(sums[label][0] / total)))
            out.means.append(mean)
            out.inverses.append(np.linalg.inv(lower))
            out.logs.append(float(np.log(np.diag(lower)).sum()))
        return out

    def density(self, label: int, x: Column) -> Column:
        """Log density of the class, up to a constant: squared Mahalanobis distance by forward substitution's factors."""
        inverse, mean = self.inverses[label], self.means[label]
        distance = F.lit(0.0)
        for i in range(len(mean)):
            z = F.lit(float(-inverse[i, :i + 1] @ mean[:i + 1]))
            for j in range(i + 1):
                z = z + x[j] * float(inverse[i, j])
            distance = distance + z * z
        return F.lit(self.shares[label] - self.logs[label]) - distance / 2

    def score(self, x: Column) -> Column:
        return 1 / (1 + F.exp(self.density(0, x) - self.density(1, x)))


def learn(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
          max_labelled: int = 100_000) -> Discriminant | float:
    """Fit on at most ``max_labelled`` labelled rows, those of the smallest id hashes; their ids alone are broadcast.

    Only each class's count, sums and sums of products come back, a few hundred numbers.  Labels other than 0 and 1 and
    null ids are left out.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).orderBy(
        F.xxhash64("__id"), "__id", "label").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("__id"), whole_text(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    x = rows.select("label", statistics(F.col("text")).alias("x"))
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    found = x.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s"),
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("p")).collect()
    sums = {}
    for r in found:
        square = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["p"]):
            square[i, j] = square[j, i] = v
        sums[r["label"]] = r["n"], np.array(r["s"]), square
    return Discriminant.fit(sums)


def quality_scores(docs: DataFrame, model: Discriminant | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every document: how likely its label is 1, from the text alone.

    Null and empty texts have the statistics of an empty text and a score like any other; repeated rows and null ids
    stay.  A model without a boundary gives all documents one score.
    """
    if isinstance(model, float):
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(model).alias("score"))
    x = docs.select(F.col(id_col).alias("doc_id"), statistics(whole_text(text_col)).alias("x"))
    return x.select("doc_id", model.score(F.col("x")).alias("score"))
