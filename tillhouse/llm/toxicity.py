"""Categories of bad text by a chain of linear classifiers.

Method: the categories are predicted one after the other. Each model is a logistic
regression over the words of the text and the probabilities of the categories before it. What a
later model learns from are probabilities that earlier models gave to documents they had
not seen: the labelled documents are cut into folds, and each fold is scored by a model of
the others. Models are those of pyspark.ml and run in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillhouse.llm.common import stored

# Labelled documents learned from, about; words known to the models, and in how many of
# those documents a word must be.
SAMPLE_DOCS = 8000
VOCABULARY = 20_000
MIN_DOCS = 10
# Lasso: few words carry a category, and labels are noisy.
PENALTY = 0.003
FOLDS = 3
# Least probability of a category that is reported.
THRESHOLD = 0.3
# Categories of the table ``labels`` in the order of the chain, with their condition.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def worded(docs: DataFrame) -> DataFrame:
    """Distinct lowered words of the whole text in ``words``."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    return docs.withColumn("words", F.array_remove(F.array_distinct(words), ""))


def _probability(name: str) -> str:
    return f"p_{name}"


@dataclass
class Link:
    """The model of one category; without both classes in the sample a constant."""

    name: str
    before: list[str]
    model: LogisticRegressionModel | None
    constant: float

    def score(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn(_probability(self.name), F.lit(self.constant))
        out = self.model.transform(_assembled(rows, self.before))
        return out.withColumn(_probability(self.name), vector_to_array("probability")[1]).drop(
            "_inputs", "rawPrediction", "probability", "prediction"
        )


@dataclass
class Chain:
    vocabulary: CountVectorizerModel
    links: list[Link]


def _assembled(rows: DataFrame, before: Sequence[str]) -> DataFrame:
    inputs = ["features", *[_probability(n) for n in before]]
    return VectorAssembler(inputCols=inputs, outputCol="_inputs").transform(rows)


def _fit(rows: DataFrame, name: str, before: list[str]) -> Link:
    label = F.col(name).cast("double")
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0.0)).alias("positive")).first()
    if not 0 < counts["positive"] < counts["n"]:
        return Link(name, before, None, counts["positive"] / counts["n"] if counts["n"] else 0.0)
    model = LogisticRegression(
        featuresCol="_inputs", labelCol="_label", regParam=PENALTY, elasticNetParam=1.0, maxIter=30,
        standardization=False,
    ).fit(_assembled(rows.withColumn("_label", label), before))
    return Link(name, before, model, 0.0)


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[tuple[str, str]] = CATEGORIES,
    sample_docs: int = SAMPLE_DOCS,
    folds: int = FOLDS,
) -> Chain:
    """The chain for ``categories`` (name, SQL condition on ``labels``).

    About ``sample_docs`` labelled ids are drawn by a hash of the id. An id labelled several
    times has a category if any of its rows says so; a condition that is null does not.
    Labels without a document and documents without a label teach nothing.
    """
    wide = 1 << 30
    known = labels.filter(F.col("doc_id").isNotNull())
    share = min(wide, wide * sample_docs // max(1, known.count()) + 1)
    flags = [F.max(F.coalesce(F.expr(when), F.lit(False))).alias(name) for name, when in categories]
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(wide)) < share).groupBy("doc_id").agg(*flags)
    # The sample is bounded, so it is broadcast.
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(folds)).alias("_fold")
    rows = stored(worded(sample).select("words", *[n for n, _ in categories], fold)).coalesce(4)
    vocabulary = CountVectorizer(
        inputCol="words", outputCol="features", vocabSize=VOCABULARY, minDF=MIN_DOCS, binary=True
    ).fit(rows) if not rows.isEmpty() else CountVectorizerModel.from_vocabulary([""], "words", "features")
    rows = vocabulary.transform(rows).drop("words")
    chain: list[Link] = []
    for i, (name, _) in enumerate(categories):
        before = [n for n, _ in categories[:i]]
        chain.append(_fit(rows, name, before))
        if i + 1 < len(categories):
            parts = [
                _fit(rows.filter(F.col("_fold") != fold), name, before).score(rows.filter(F.col("_fold") == fold))
                for fold in range(folds)
            ]
            unseen = parts[0]
            for part in parts[1:]:
                unseen = unseen.unionByName(part)
            rows = stored(unseen).coalesce(4)
    return Chain(vocabulary, chain)


def predict(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` of every row of ``docs`` with a probability and a flag per category.

    A null or empty text has no words and gets what the models say of such; repeated rows
    get the same each. Other columns are ignored; an empty table gives an empty result.
    """
    rows = chain.vocabulary.transform(worded(docs.select("doc_id", "text")).drop("text")).drop("words")
    for link in chain.links:
        rows = link.score(rows)
    flags: list[Column] = [(F.col(_probability(c.name)) >= threshold).alias(c.name) for c in chain.links]
    return rows.select("doc_id", *[_probability(c.name) for c in chain.links], *flags)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, train(docs, labels))
