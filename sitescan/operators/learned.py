"""A learned alternative to the word lists, with confidences that match how often it is right."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import restored

# Columns that exist only while texts are scored.
TEXT, LABEL, TRUE, SURE = "_learned_text", "_learned_label", "_learned_true", "_learned_sure"
WORKING = ["_learned_words", "_learned_counts", "_learned_features", "_learned_raw", "_learned_probability", "_learned_class"]
# The curve is fitted on counts per probability, rounded to this many steps, so its size does not grow.
STEPS = 1000


class LearnedClassifier:
    """TF-IDF and logistic regression, then an isotonic curve from probabilities to shares of right answers."""

    def __init__(self, model: PipelineModel, curve: IsotonicRegressionModel):
        self.model, self.curve = model, curve

    @classmethod
    def train(cls, texts: DataFrame, text: str = "text", label: str = "label",
              features: int = 1 << 16, held_out: int = 5, iterations: int = 20) -> "LearnedClassifier":
        """Fit on labelled texts; one text of `held_out` is kept for the curve, copies on the same side.

        Rows without a label are left out, null texts count as empty. With too few texts to hold
        any out, all serve both purposes.
        """
        known = texts.select(F.coalesce(F.col(text), F.lit("")).alias(TEXT), F.col(label).cast("string").alias(TRUE)).where(F.col(TRUE).isNotNull())
        side = F.pmod(F.xxhash64(TEXT), F.lit(held_out)) == 0
        fitted, kept = known.where(~side), known.where(side)
        if fitted.isEmpty() or kept.isEmpty():
            fitted = kept = known
        if known.isEmpty():
            raise ValueError("no labelled texts to learn from")
        words, counts, weighed, raw, probability, number = WORKING
        index = StringIndexer(inputCol=TRUE, outputCol="_learned_index", stringOrderType="alphabetAsc").fit(fitted)
        model = Pipeline(stages=[
            RegexTokenizer(inputCol=TEXT, outputCol=words, pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol=words, outputCol=counts, numFeatures=features),
            IDF(inputCol=counts, outputCol=weighed),
            LogisticRegression(
                featuresCol=weighed, labelCol="_learned_index", rawPredictionCol=raw, probabilityCol=probability,
                predictionCol=number, maxIter=iterations, regParam=0.01,
            ),
            IndexToString(inputCol=number, outputCol=LABEL, labels=index.labels),
        ]).fit(index.transform(fitted))
        model = restored(model, texts.sparkSession)
        scored = model.transform(kept)
        points = scored.groupBy((F.round(_highest() * STEPS) / STEPS).alias("x")).agg(
            F.avg((F.col(LABEL) == F.col(TRUE)).cast("double")).alias("y"), F.count("*").cast("double").alias("n")
        )
        curve = IsotonicRegression(featuresCol="x", labelCol="y", weightCol="n", predictionCol=SURE).fit(points)
        return cls(model, curve.setFeaturesCol("_learned_highest"))

    def predict(self, rows: DataFrame, text: str = "text", label: str = "label", confidence: str = "confidence") -> DataFrame:
        """`rows` with `label` and `confidence`, 0 to 100: of all answers given with it, so many in a hundred are right."""
        scored = self.model.transform(rows.withColumn(TEXT, F.coalesce(F.col(text), F.lit(""))))
        sure = self.curve.transform(scored.withColumn("_learned_highest", _highest()))
        percent = F.round(F.col(SURE) * 100).cast("int")
        return sure.withColumn(label, F.col(LABEL)).withColumn(confidence, percent).drop(TEXT, LABEL, SURE, "_learned_highest", *WORKING)

    def site_types(self, classified: DataFrame) -> DataFrame:
        """Rows of `classify_sites` with the learned site type in place of the word lists' one."""
        body = "full_text" if "full_text" in classified.columns else "body_text"
        texts = classified.withColumn("_page", F.concat_ws(" ", "url", "title", "meta_description", body))
        found = self.predict(texts, "_page", "site_type", "_certain")
        return found.withColumn("confidence", F.col("confidence").withField("site_type", F.col("_certain"))).drop("_page", "_certain")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.curve.write().overwrite().save(f"{path}/curve")

    @classmethod
    def load(cls, path: str) -> "LearnedClassifier":
        return cls(PipelineModel.load(f"{path}/model"), IsotonicRegressionModel.load(f"{path}/curve"))


def _highest():
    return F.array_max(vector_to_array("_learned_probability"))
