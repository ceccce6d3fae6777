"""Quality classifier by co-training of a text view and a page-metadata view."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busweave.llm.common import WORD, small_batches
from busweave.session import checkpointed

DIMENSIONS, META_DIMENSIONS = 1 << 13, 1 << 9
#: A pseudo-label needs this probability of either class; at most so many a round go each way.
CONFIDENT, PER_ROUND = 0.95, 1_000
#: Tasks of a pass over the training sample, whose size is bounded. So few are summed up without a second stage.
FIT_TASKS = 4
WORDS, LETTERS, NUMBERS = re.compile(WORD), regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+")
OTHERS, CAPITALS = regex.compile(r"[^\p{L}\p{N}]"), regex.compile(r"\p{Lu}")
#: Classes of ASCII characters: capitals as A, other letters as a, digits as 0, the rest unchanged.
CLASSES = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in map(chr, range(128)))
RUNS = re.compile(r"(a)a+|(0)0+")


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def coordinate(term: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "replace"), seed) >> 1


class Words:
    """What the views need of a word, worked out once per distinct word; ``bound`` words are kept between texts."""

    def __init__(self, bound: int = 200_000):
        self.bound, self.seen, self.fresh, self.facts, self.shapes = bound, {}, [], np.zeros((1, 5), np.int64), {}

    def add(self, word: str) -> int:
        at = self.seen[word] = len(self.seen) + 1
        if word.isascii():
            classes = word.translate(CLASSES)
            capitals, digits = classes.count("A"), classes.count("0")
            classes = classes.lower()
            others = len(word) - classes.count("a") - digits
            shape = RUNS.sub(r"\1\2", classes) if digits or others else "a"
        else:
            shape, others = NUMBERS.sub("0", LETTERS.sub("a", word)), len(OTHERS.findall(word))
            digits, capitals = sum(map(len, NUMBERS.findall(word))), len(CAPITALS.findall(word))
        place = self.shapes.get(shape[:24])
        if place is None:
            place = self.shapes[shape[:24]] = coordinate(shape[:24], 1)
        self.fresh.append((coordinate(word.lower(), 0), place, others, digits, capitals))
        return at

    def views(self, text: str | None, n_chars: float | None) -> tuple[np.ndarray, list[float]]:
        """Distinct coordinates of words and word shapes; numbers of the page's layout."""
        if len(self.seen) > self.bound:
            self.__init__(self.bound)
        text, get, add = text or "", self.seen.get, self.add
        at, times = np.unique(np.array([get(w) or add(w) for w in WORDS.findall(text)], np.int64), return_counts=True)
        if self.fresh:
            start, more = len(self.seen) - len(self.fresh) + 1, len(self.fresh)
            if start + more > len(self.facts):
                self.facts = np.concatenate([self.facts, np.zeros((max(len(self.facts), more), 5), np.int64)])
            self.facts[start : start + more] = self.fresh
            self.fresh.clear()
        facts, size, n_words = self.facts[at], max(len(text), 1), max(int(times.sum()), 1)
        others, digits, capitals = (times @ facts[:, 2:]) / size
        length = size if n_chars is None or not n_chars >= 0 else n_chars
        numbers = [np.log1p(length) / 10, np.log1p(text.count("\n")) / 5, n_words / size, len(np.unique(facts[:, 0])) / n_words]
        return np.unique(facts[:, :2] % DIMENSIONS), [*numbers, others, digits, capitals]


def described(batch: pa.RecordBatch, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, list[float]]]:
    """Per row: coordinates of the text view, coordinates and numbers of the metadata view. Absent columns count as null."""
    column = lambda c: batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows
    for text, source, lang, n_chars in zip(*map(column, ("text", "source", "lang", "n_chars"))):
        names = [f"{c} {'none' if v is None else v}" for c, v in (("source", source), ("lang", lang))]
        at, numbers = words.views(text, None if n_chars is None else float(n_chars))
        yield at, np.unique([coordinate(n, 2) % META_DIMENSIONS for n in names]), numbers


def views(docs: DataFrame) -> DataFrame:
    """``docs`` with the vectors of both views, for a sample to train on.

    Text: which lower-cased words and word shapes (letters as a, digits as 0) occur, hashed. Metadata: source, language
    and length as the table has them, and how the page is laid out: lines, word lengths, shares of symbols, digits and
    capitals, share of distinct words. Null text counts as empty; null metadata is a value of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in small_batches(batches):
            terms, names, numbers = zip(*((at.astype(str).tolist(), who.astype(str).tolist(), n) for at, who, n in described(batch, words)))
            new = [pa.array(terms, pa.list_(pa.string())), pa.array(names, pa.list_(pa.string())), pa.array(numbers, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "__terms", "__names", "__numbers"])

    added = [("__terms", T.ArrayType(T.StringType())), ("__names", T.ArrayType(T.StringType())), ("__numbers", T.ArrayType(T.DoubleType()))]
    wide = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, kind) for n, kind in added]]))
    for source, size, out in (("__terms", DIMENSIONS, "__tf"), ("__names", META_DIMENSIONS, "__who")):
        wide = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], source, out, binary=True).transform(wide)
    wide = Normalizer(inputCol="__tf", outputCol="text_view").transform(wide.withColumn("__numbers", array_to_vector("__numbers")))
    wide = VectorAssembler(inputCols=["__who", "__numbers"], outputCol="meta_view").transform(wide)
    return wide.drop("__terms", "__names", "__numbers", "__tf", "__who")


def learner(view: str) -> LogisticRegression:
    return LogisticRegression(featuresCol=view, labelCol="y", maxIter=20, regParam=1e-4 if view == "text_view" else 1e-3)


def margin(model: LogisticRegressionModel, rows: DataFrame, out: str) -> DataFrame:
    """``rows`` with the model's log-odds of class 1."""
    scored = model.setRawPredictionCol("__raw").setProbabilityCol("").setPredictionCol("").transform(rows)
    return scored.withColumn(out, vector_to_array("__raw")[1]).drop("__raw")


def both_classes(rows: DataFrame) -> bool:
    low, high = rows.agg(F.min("y"), F.max("y")).first()
    return low == 0 and high == 1


class CoTrained:
    """Both views' models and their calibrations (slope, offset)."""

    def __init__(self, models: dict[str, LogisticRegressionModel], scales: dict[str, tuple[float, float]], prior: float):
        self.models, self.scales, self.prior = models, scales, prior

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``quality``: the mean of the views' calibrated log-odds as a probability."""
        if not self.models:
            return docs.withColumn("quality", F.lit(self.prior))
        # Both views' weights, each scaled by its calibration and halved, add up to one linear score.
        share = {v: a / len(self.scales) for v, (a, _) in self.scales.items()}
        offset = sum(self.models[v].intercept * share[v] + b / len(self.scales) for v, (_, b) in self.scales.items())
        weights = [self.models[v].coefficients.toArray() * share[v] for v in ("text_view", "meta_view")]
        model = docs.sparkSession.sparkContext.broadcast(weights)
        kept = docs.drop("quality")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (on_text, on_meta), words = model.value, Words()
            on_numbers = on_meta[META_DIMENSIONS:]
            for batch in small_batches(batches):
                sums = [
                    on_text[at].sum() / np.sqrt(max(len(at), 1)) + on_meta[who].sum() + on_numbers @ numbers
                    for at, who, numbers in described(batch, words)
                ]
                value = 1 / (1 + np.exp(-np.clip(np.array(sums, float) + offset, -35, 35)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, "quality"])

        return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("quality", T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = 2, max_labelled: int = 8_000, max_pool: int = 8_000) -> CoTrained:
    """Co-train on at most ``max_labelled`` labelled rows outside the held-out fold and a pool of ``max_pool`` others.

    Both are the rows of smallest hash; their ids, bounded by the two parameters, are broadcast. A fifth of the labelled
    rows calibrates and is never trained on. In each round both views learn, label the pool, and give the other view
    those rows that they are sure of. With labels of one class only, or none, every score is that class's share (0.5
    without labels).
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    others = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().join(labels.select("doc_id"), "doc_id", "left_anti")
    pool_ids = others.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_pool).withColumn("y", F.lit(None).cast("double"))
    part = F.when(F.col("y").isNull(), "pool").when(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0, "calibrate").otherwise("train")
    picked = chosen.unionByName(pool_ids).withColumn("part", part)
    inputs = [c for c in ("doc_id", "text", "source", "lang", "n_chars") if c in docs.columns]
    rows = views(docs.select(*inputs).join(F.broadcast(picked), "doc_id")).select("doc_id", "y", "part", "text_view", "meta_view")
    rows = checkpointed(rows, "views")
    train, pool, check = (rows.where(F.col("part") == p) for p in ("train", "pool", "calibrate"))
    if not both_classes(train):
        share = rows.agg(F.avg("y")).first()[0]
        return CoTrained({}, {}, 0.5 if share is None else float(share))
    names = ("text_view", "meta_view")
    sets, models = {v: train.select("y", *names) for v in names}, {}
    for turn in range(rounds + 1):
        models = {v: learner(v).fit(sets[v].coalesce(FIT_TASKS)) for v in names}
        if turn == rounds:
            break
        for view, other in (names, names[::-1]):
            sure = margin(models[view], pool, "m").withColumn("p", 1 / (1 + F.exp(-F.col("m"))))
            sure = sure.where((F.col("p") >= CONFIDENT) | (F.col("p") <= 1 - CONFIDENT))
            sure = sure.orderBy(F.desc(F.abs("m")), "doc_id").limit(PER_ROUND).withColumn("y", (F.col("p") >= 0.5).cast("double"))
            sets[other] = checkpointed(train.select("y", *names).unionByName(sure.select("y", *names)), "co-training-set")
    scales = {v: (1.0, 0.0) for v in names}
    if both_classes(check):
        for view in names:
            scored = margin(models[view], check, "m").select("y", array_to_vector(F.array("m")).alias("at"))
            platt = LogisticRegression(featuresCol="at", labelCol="y", maxIter=20).fit(scored.coalesce(FIT_TASKS))
            scales[view] = (float(platt.coefficients[0]), float(platt.intercept))
    return CoTrained(models, scales, 0.5)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("quality").alias("score"),
        (F.col("quality") >= 0.5).cast("int").alias("predicted"),
    )
