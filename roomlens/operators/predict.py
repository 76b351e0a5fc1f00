"""How well nuisance columns predict a label: logistic regression by grouped folds."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def predictability(df: DataFrame, label: str, group: str, categories: list[str], numbers: list[str], folds: int = 5, rounds: int = 50) -> DataFrame:
    """Rows: fold, n, balanced_accuracy (mean recall of the labels in the fold), macro_f1, chance (one over the labels in the fold). Groups
    are dealt over the folds by a hash, so no group is trained on and scored. Categories are one-hot (one that does not train has no weight), the learner
    scales by the training rows, null numbers count as 0, labels weigh alike. Labels and categories are indexed once, for all folds. Rows without a label are left out; a fold is left
    out if it is empty or one label trains it."""
    rows = df.filter(F.col(label).isNotNull()).select(F.pmod(F.xxhash64(group), F.lit(folds)).cast("int").alias("fold"), F.col(label).cast("string").alias("_label"),
                                                      *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in categories], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numbers])
    stages = [StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc")]
    if categories:
        stages += [StringIndexer(inputCols=categories, outputCols=[f"_i_{c}" for c in categories]), OneHotEncoder(inputCols=[f"_i_{c}" for c in categories], outputCols=[f"_o_{c}" for c in categories], dropLast=False)]
    stages += [VectorAssembler(inputCols=[*[f"_o_{c}" for c in categories], *numbers], outputCol="_x")] if categories or numbers else []
    counts = {(r["fold"], r["_label"]): r["n"] for r in rows.groupBy("fold", "_label").agg(F.count("*").alias("n")).collect()}
    names, out = sorted({k for _, k in counts}), None
    if names:
        made = Pipeline(stages=stages).fit(rows).transform(rows)
        made = cut(made.select("fold", "_label", "_y", "_x" if "_x" in made.columns else F.lit(None).alias("_x")))
    for f in range(folds):
        train = {k: sum(n for (g, x), n in counts.items() if g != f and x == k) for k in names}
        train = {k: n for k, n in train.items() if n}
        if len(train) < 2 or not any(g == f for g, _ in counts):
            continue
        own, test = made.filter(F.col("fold") != f), made.filter(F.col("fold") == f)
        if categories or numbers:
            weight = F.create_map(*[F.lit(x) for k, n in train.items() for x in (k, sum(train.values()) / (len(train) * n))])
            learner = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, regParam=1e-4)
            said = learner.fit(own.withColumn("_w", weight[F.col("_label")])).transform(test).select("_y", "prediction")
        else:  # labels weigh alike, so the first is as good as any
            said = test.select("_y", F.lit(float(names.index(min(train)))).alias("prediction"))
        cells = said.groupBy("_y", "prediction").agg(F.count("*").alias("n"))
        true = cells.groupBy(F.col("_y").alias("k")).agg(F.sum("n").alias("s"), F.sum(F.when(F.col("_y") == F.col("prediction"), F.col("n")).otherwise(0)).alias("h"))
        x = true.join(cells.groupBy(F.col("prediction").alias("k")).agg(F.sum("n").alias("q")), "k", "left")
        one = x.agg(F.lit(f).alias("fold"), F.sum("s").alias("n"), F.avg(F.col("h") / F.col("s")).alias("balanced_accuracy"), F.avg(2 * F.col("h") / (F.col("s") + F.coalesce("q", F.lit(0)))).alias("macro_f1"), (1 / F.count("*")).alias("chance"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else df.sparkSession.createDataFrame([], "fold int, n long, balanced_accuracy double, macro_f1 double, chance double")
