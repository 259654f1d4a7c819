"""Text features and classifiers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.feature import HashingTF, IDF, IndexToString, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.param import Param, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noctiluca.functions import text
from noctiluca.session import spread

VOCABULARY = 8000


def encode_labels(df: DataFrame, label: str = "category") -> DataFrame:
    """(label, code): codes 0, 1, ... in the order of the labels."""
    labels = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct()
    return labels.withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))  # one row per label


def _counted_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): the words and word pairs of each text, counted within its row."""
    rows = spread(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    return rows.select("id", F.explode(text.counted(text.ngrams_1_2(text.tokens(F.col("text"))))).alias("t")).select("id", "t.term", "t.tf")


def term_statistics(df: DataFrame, id_col: str, text_col: str, limit: int = VOCABULARY) -> DataFrame:
    """(term, total, df): the most frequent words and word pairs of the corpus, ties by term. Terms are counted within each
    row, so one shuffle, by term and with partial sums, is enough; the vocabulary is a top-k."""
    return _counted_terms(df, id_col, text_col).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(limit)


def _weight(tf: Column, n: Column, df: Column) -> Column:
    return (1 + F.log(tf)) * (F.log((1 + n) / (1 + df)) + 1)


def tfidf(df: DataFrame, id_col: str, text_col: str, limit: int = VOCABULARY) -> DataFrame:
    """(id, term, weight): (1 + ln tf) x (ln((1 + n) / (1 + df)) + 1), each document scaled to length 1, over the
    vocabulary of ``term_statistics``. The vocabulary has at most ``limit`` rows and is broadcast, so only its terms leave
    a row; one shuffle by id brings a document's terms together for its length."""
    vocabulary = F.broadcast(term_statistics(df, id_col, text_col, limit).select("term", "df"))
    n = df.agg(F.count("*").alias("n"))
    raw = _counted_terms(df, id_col, text_col).join(vocabulary, "term").crossJoin(F.broadcast(n)).select("id", "term", _weight(F.col("tf"), F.col("n"), F.col("df")).alias("w"))
    return raw.withColumn("weight", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))), 6)).select("id", "term", "weight")


def token_sequences(df: DataFrame, id_col: str, text_col: str, length: int = 64, limit: int = VOCABULARY) -> DataFrame:
    """(id, input_ids, attention_mask): each text as exactly ``length`` word numbers, cut or padded with 0. Words are
    numbered from 2 by their frequency in the corpus (ties by word), all beyond the ``limit`` most frequent ones are 1."""
    words = text.tokens(F.coalesce(F.col(text_col), F.lit("")))
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(limit)
    numbered = F.broadcast(counts.withColumn("number", F.row_number().over(Window.orderBy(F.desc("n"), "word")) + 1).select("word", "number"))
    rows = df.select(F.col(id_col).alias("id"), F.posexplode_outer(F.slice(words, 1, length)).alias("pos", "word")).join(numbered, "word", "left")
    held = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", F.coalesce("number", F.lit(1)).alias("number"))))).alias("p"))
    ids, pad = F.transform("p", lambda x: x["number"]), F.lit(length) - F.size("p")
    return held.select("id", F.concat(ids, F.array_repeat(F.lit(0), pad)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size("p")), F.array_repeat(F.lit(0), pad)).alias("attention_mask"))


class TermVectors(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The weights of ``tfidf`` as one sparse vector a row, over a vocabulary that was fitted before."""

    def __init__(self, text_col: str = "combined_text", terms: list[str] | None = None, idf: list[float] | None = None):
        super().__init__()
        for name, kind in (("text_col", TypeConverters.toString), ("terms", TypeConverters.toListString), ("idf", TypeConverters.toListFloat)):
            setattr(self, name, Param(self, name, name, kind))
        self._set(text_col=text_col, terms=terms or [], idf=idf or [])

    def _transform(self, df: DataFrame) -> DataFrame:
        terms, idf = self.getOrDefault(self.terms), self.getOrDefault(self.idf)
        shared = df.sparkSession.sparkContext.broadcast(({t: i for i, t in enumerate(terms)}, idf))

        def vector(words: list[str]) -> SparseVector:
            place, weights = shared.value
            tf: dict[int, int] = {}
            for t in words:
                if (i := place.get(t)) is not None:
                    tf[i] = tf.get(i, 0) + 1
            raw = {i: (1 + math.log(n)) * weights[i] for i, n in tf.items()}
            size = math.sqrt(sum(v * v for v in raw.values())) or 1.0
            return SparseVector(len(weights), {i: v / size for i, v in raw.items()})

        words = text.ngrams_1_2(text.tokens(F.coalesce(F.col(self.getOrDefault(self.text_col)), F.lit(""))))
        return df.withColumn("features", F.udf(vector, VectorUDT())(words))


def fit_term_vectors(df: DataFrame, text_col: str, limit: int = VOCABULARY) -> TermVectors:
    """Vocabulary and document frequencies of ``tfidf``; at most ``limit`` rows come to the driver."""
    n = df.count()
    rows = term_statistics(df, text_col, text_col, limit).collect()
    return TermVectors(text_col, [r["term"] for r in rows], [math.log((1 + n) / (1 + r["df"])) + 1 for r in rows])


def _word_stages(text_col: str) -> list:
    """Stages from text to words."""
    split = RegexTokenizer(inputCol="_clean", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
    clean = SQLTransformer(statement=f"SELECT *, translate(lower(coalesce({text_col}, '')), '{text.ACCENTED}', '{text.BASE}') AS _clean FROM __THIS__")
    return [clean, split]


def train_svm(train: DataFrame, text_col: str = "combined_text", label_col: str = "category", c: float = 1.0, limit: int = VOCABULARY, rounds: int = 10) -> PipelineModel:
    """One linear support-vector classifier per label over the weights of ``tfidf``; the regularisation is 1 / (c n)."""
    n = max(1, train.count())
    index = StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="error")
    svm = OneVsRest(classifier=LinearSVC(regParam=1.0 / (c * n), maxIter=rounds), parallelism=4, featuresCol="features", labelCol="_label", predictionCol="_code")
    return _with_names(train, index, [fit_term_vectors(train, text_col, limit)], svm)


def train_network(train: DataFrame, text_col: str = "combined_text", label_col: str = "category", hidden: int = 64, hashed: int = 1024, seed: int = 42, rounds: int = 40, backbone: str | None = None) -> PipelineModel:
    """A small feed-forward network over hashed words. ``backbone`` names the pretrained model that is wanted instead; none
    can be had here, so any name but None raises. It stands in for fine-tuning a transformer, which needs libraries
    and models that are not here; its scores say nothing about such a model's."""
    if backbone is not None:
        raise NotImplementedError(f"no pretrained model here: {backbone}")
    labels = train.select(label_col).distinct().count()
    index = StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="error")
    net = MultilayerPerceptronClassifier(layers=[hashed, hidden, max(2, labels)], featuresCol="features", labelCol="_label", predictionCol="_code", seed=seed, maxIter=rounds)
    return _with_names(train, index, [*_word_stages(text_col), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=hashed), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features")], net)


def _with_names(train: DataFrame, index: StringIndexer, stages: list, classifier, partitions: int = 64) -> PipelineModel:
    """Fit the stages, keep the features for the many passes of the classifier, and add the names of the labels. Features
    are gathered in at most ``partitions`` parts when there are more, for every pass is a job over all parts."""
    fitted = index.fit(train)
    features = Pipeline(stages=stages).fit(train)
    ready = fitted.transform(features.transform(train)).select("features", "_label").coalesce(partitions).persist()
    model = classifier.fit(ready)
    ready.unpersist()
    return PipelineModel(stages=[*features.stages, model, IndexToString(inputCol="_code", outputCol="predicted", labels=fitted.labels)])


def loss_history(model: PipelineModel) -> list[tuple[str, int, float]]:
    """(label, round, mean loss) of a model that was just trained; the network has one history, labelled ''. A model that
    was loaded has none."""
    names = model.stages[-1].getLabels()
    fitted = model.stages[-2]
    parts = zip(names, fitted.models, strict=False) if isinstance(fitted, OneVsRestModel) else [("", fitted)]
    return [(label, i, float(v)) for label, m in parts if m.hasSummary for i, v in enumerate(m.summary().objectiveHistory)]


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.drop(*[c for c in out.columns if c.startswith("_") or c in ("features", "rawPrediction", "probability")])


def train_classifier(train: DataFrame, version: str = "v1", **options) -> PipelineModel:
    """v1: linear classifiers over tf-idf; v2: the network."""
    if version not in ("v1", "v2"):
        raise ValueError(f"unknown classifier version: {version}")
    return (train_svm if version == "v1" else train_network)(train, **options)


def encode_with(encode: Callable[[list[str]], np.ndarray], dim: int, batch: int = 256) -> Callable[..., DataFrame]:
    """An embedder from a function of a list of texts to an array of vectors, such as a language model's ``encode``: it
    takes (df, id_col, text_col) and gives (id, vec) with unit vectors, Arrow batch by Arrow batch."""

    def embed(df: DataFrame, id_col: str = "paper_id", text_col: str = "combined_text") -> DataFrame:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for at in range(0, len(b), batch):
                    part = b.iloc[at : at + batch]
                    x = np.asarray(encode(part["text"].tolist()), np.float64).reshape(len(part), dim)
                    size = np.linalg.norm(x, axis=1, keepdims=True)
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": list(x / np.where(size > 0, size, 1))})

        flat = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        return flat.mapInPandas(each, "id bigint, vec array<double>")

    return embed


def hashing_embedder(df: DataFrame, id_col: str = "paper_id", text_col: str = "combined_text", dim: int = 128) -> DataFrame:
    """(id, vec): unit vectors of signed, hashed word counts; stands in where no language model is at hand."""
    words = df.select(F.col(id_col).alias("id"), F.explode(text.tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("w")).groupBy("id", "w").agg(F.count("*").alias("tf"))
    cells = words.select("id", F.pmod(F.xxhash64("w"), F.lit(dim)).alias("cell"), (F.when(F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2)) == 0, 1).otherwise(-1) * (1 + F.log("tf"))).alias("v")).groupBy("id", "cell").agg(F.sum("v").alias("v"))
    rows = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm")).where("norm > 0")
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0.0)) / F.col("norm")).alias("vec"))


def majority_label(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(src_id, predicted): the most frequent label among a source's neighbours, ties by label."""
    counted = neighbours.join(labels.select(F.col("id").alias("dst_id"), "label"), "dst_id").groupBy("src_id", "label").agg(F.count("*").alias("n"))
    by = Window.partitionBy("src_id").orderBy(F.desc("n"), "label")
    return counted.withColumn("p", F.row_number().over(by)).where("p = 1").select("src_id", F.col("label").alias("predicted"))
