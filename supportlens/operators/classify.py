"""A multinomial intent classifier over TF-IDF terms with abstention, on the ML pipeline.

Fitted on at most ``sample`` labelled rows (the rows of smallest hash); every row is scored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER = "other_unclear"


def fit(rows: DataFrame, text: str, label: str, *, sample: int = 20_000, features: int = 1 << 14, c: float = 1.0) -> PipelineModel:
    """Balanced class weights; rejects empty input and the label that stands for none."""
    known = rows.select(F.col(text).alias("text"), F.col(label).alias("label")).filter("text is not null and label is not null")
    known = known.orderBy(F.xxhash64("text", "label")).limit(sample)
    per = known.groupBy("label").count()
    n, classes = per.agg(F.sum("count"), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("no labelled rows")
    if per.filter(F.col("label") == OTHER).count():
        raise ValueError(f"{OTHER} is no class to learn")
    weighted = known.join(F.broadcast(per), "label").withColumn("weight", F.lit(float(n)) / (F.lit(float(classes)) * F.col("count"))).drop("count")  # one row per class
    stages = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern="[^\\p{L}\\p{N}_]+", minTokenLength=2),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        HashingTF(inputCol="words", outputCol="tf1", numFeatures=features),
        HashingTF(inputCol="pairs", outputCol="tf2", numFeatures=features),
        VectorAssembler(inputCols=["tf1", "tf2"], outputCol="tf"),
        IDF(inputCol="tf", outputCol="tfidf", minDocFreq=2),
        Normalizer(inputCol="tfidf", outputCol="features"),
        (index := StringIndexer(inputCol="label", outputCol="index", stringOrderType="alphabetAsc", handleInvalid="skip")),
        LogisticRegression(featuresCol="features", labelCol="index", weightCol="weight", family="multinomial", standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * n), maxIter=60),
    ]
    model = Pipeline(stages=stages).fit(weighted)
    names = model.stages[stages.index(index)].labels
    rest = [s for s in model.stages if not s.uid.startswith("StringIndexer")]
    return PipelineModel([*rest, IndexToString(inputCol="prediction", outputCol="predicted", labels=names)])


def predict(model: PipelineModel, rows: DataFrame, text: str, threshold: float | None = None) -> DataFrame:
    """Adds intent, confidence and abstained; strictly below the threshold the intent is ``other_unclear``."""
    scored = model.transform(rows.withColumn("text", F.col(text)).filter("text is not null"))
    top = F.array_max(vector_to_array("probability"))
    low = top < threshold if threshold is not None else F.lit(False)
    return scored.select(*rows.columns, F.when(low, OTHER).otherwise(F.col("predicted")).alias("intent"), top.alias("confidence"), low.alias("abstained"))
