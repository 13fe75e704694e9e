"""Text classifiers: TF-IDF with logistic regression or a linear support vector machine, held out, chosen, and
validated by fold or by group. Models are fitted on at most ``max_train_rows`` rows in hash order; all others are predicted."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import HashingTF, IDF, IndexToString, NGram, SQLTransformer, StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import tokens
from colloquy.runtime import checkpoint

#: The variants of the baseline: name -> (learner, n-grams up to, balanced classes).
VARIANTS = {
    "logreg_unigram": ("logreg", 1, False), "logreg_bigram": ("logreg", 2, False), "logreg_unigram_balanced": ("logreg", 1, True),
    "logreg_bigram_balanced": ("logreg", 2, True), "svc_unigram_balanced": ("svc", 1, True), "svc_bigram_balanced": ("svc", 2, True),
}


def hashed(df: DataFrame, row_id: str, seed: int = 42):
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.col(row_id).cast("string")), 256)


def stratified(df: DataFrame, label: str, row_id: str, test_share: float, seed: int = 42) -> DataFrame:
    """Adds fold: test for rows whose seeded hash lies in the first ``test_share`` of its range, else train.

    Each label is thinned alike, as hashes are even, and no task orders the rows of a label."""
    part = F.conv(F.substring(hashed(df, row_id, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("fold", F.when(part < test_share, "test").otherwise("train"))


def folded(df: DataFrame, row_id: str, k: int, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to k - 1, by the seeded hash of the row."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(hashed(df, row_id, seed), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def prepared(df: DataFrame, *, row_id: str, text: str, label: str, keep: list[str] = ()) -> DataFrame:
    """(id, truth, words, keep...) of rows with text and label."""
    rows = df.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    return rows.select(F.col(row_id).alias("id"), F.col(label).alias("truth"), tokens(F.col(text), "[a-z0-9']+").alias("words"), *keep)


def fit_predict(train: DataFrame, test: DataFrame, *, variant: str = "logreg_bigram", max_train_rows: int = 50_000, features: int = 1 << 14) -> DataFrame:
    """test with predicted and majority. With fewer than two labels to learn from the prediction is the majority label, of
    equal ones the first in order; without any it is null."""
    learner, grams, balanced = VARIANTS[variant]
    train = train.orderBy(F.sha2(F.col("id").cast("string"), 256)).limit(max_train_rows)
    n = train.groupBy("truth").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "truth")
    top = n.limit(2).collect()
    test = test.withColumn("majority", F.lit(top[0]["truth"] if top else None).cast("string"))
    if len(top) < 2:
        return test.withColumn("predicted", F.col("majority"))
    names = StringIndexer(inputCol="truth", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    total = n.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    weights = n.join(F.broadcast(total)).select("truth", (F.col("all") / F.col("k") / F.col("n")).alias("w"))
    train = train.join(F.broadcast(weights), "truth") if balanced else train.withColumn("w", F.lit(1.0))
    if learner == "logreg":
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=30, regParam=0.01)
    else:
        model = OneVsRest(classifier=LinearSVC(featuresCol="x", maxIter=20, regParam=0.01), featuresCol="x", labelCol="y", weightCol="w", parallelism=4)
    steps = [NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="select *, concat(words, pairs) as terms from __THIS__")] if grams == 2 else [SQLTransformer(statement="select *, words as terms from __THIS__")]
    steps += [HashingTF(inputCol="terms", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="x", minDocFreq=1), model]
    fitted = Pipeline(stages=steps).fit(names.transform(train))
    out = IndexToString(inputCol="prediction", outputCol="predicted", labels=names.labels).transform(fitted.transform(test))
    return out.select(*test.columns, "predicted")


def holdout_predictions(df: DataFrame, *, row_id: str, text: str, label: str, test_share: float = 0.25, variant: str = "logreg_bigram", **kw) -> DataFrame:
    """(row_id, truth, predicted, majority) of the held-out rows; rows without text or label take no part."""
    rows = stratified(prepared(df, row_id=row_id, text=text, label=label), "truth", "id", test_share)
    out = fit_predict(rows.where("fold = 'train'"), rows.where("fold = 'test'"), variant=variant, **kw)
    return out.select(F.col("id").alias(row_id), "truth", "predicted", "majority")


def cross_validated(df: DataFrame, *, row_id: str, text: str, label: str, k: int = 5, variant: str = "logreg_bigram", **kw) -> DataFrame:
    """(row_id, fold, truth, predicted, majority): every row predicted by the model of the other folds."""
    rows = checkpoint(folded(prepared(df, row_id=row_id, text=text, label=label), "id", k))
    parts = [fit_predict(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i), variant=variant, **kw) for i in range(k)]
    return reduce(DataFrame.unionByName, parts).select(F.col("id").alias(row_id), "fold", "truth", "predicted", "majority")


def group_validated(df: DataFrame, *, row_id: str, text: str, label: str, group: str, k: int = 5, variant: str = "logreg_bigram", **kw) -> DataFrame:
    """As cross_validated(), but rows of a group are never on both sides: groups are dealt to ``k`` folds by hash (leave one
    group out where there are no more groups than folds)."""
    rows = prepared(df, row_id=row_id, text=text, label=label, keep=[group]).where(F.col(group).isNotNull())
    rows = checkpoint(folded(rows, group, k))
    parts = [fit_predict(rows.where(F.col("fold") != i), rows.where(F.col("fold") == i), variant=variant, **kw) for i in range(k)]
    return reduce(DataFrame.unionByName, parts).select(F.col("id").alias(row_id), group, "fold", "truth", "predicted", "majority")


def compare_variants(df: DataFrame, *, row_id: str, text: str, label: str, variants: list[str] | None = None, **kw) -> DataFrame:
    """(variant, n, accuracy, macro_f1, rank) of held-out predictions of each variant and of the majority, the best first."""
    rows = checkpoint(stratified(prepared(df, row_id=row_id, text=text, label=label), "truth", "id", 0.25))
    train, test = rows.where("fold = 'train'"), rows.where("fold = 'test'")
    parts = []
    for name in variants or list(VARIANTS):
        p = fit_predict(train, test, variant=name, **kw)
        parts.append(p.select(F.lit(name).alias("variant"), "truth", "predicted"))
    parts.append(p.select(F.lit("majority").alias("variant"), "truth", F.col("majority").alias("predicted")))
    n = reduce(DataFrame.unionByName, parts).groupBy("variant", "truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    n = checkpoint(n)
    side = lambda c, name: n.groupBy("variant", F.col(c).alias("label")).agg(F.sum("n").alias(name))
    hits = n.where("truth = predicted").select("variant", F.col("truth").alias("label"), F.col("n").alias("tp"))
    each = side("truth", "t").join(side("predicted", "p"), ["variant", "label"], "full_outer").join(hits, ["variant", "label"], "left").fillna(0, ["t", "p", "tp"])
    f1 = F.when(F.col("t") + F.col("p") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)
    g = each.groupBy("variant").agg(F.sum("t").alias("n"), F.round(F.sum("tp") / F.sum("t"), 4).alias("accuracy"), F.round(F.avg(f1), 4).alias("macro_f1"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("macro_f1"), "variant")))
