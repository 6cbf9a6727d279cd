"""Text fact and HTML cleanup (C1-C3, N1). and the text classifier."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.functions.expressions import html_to_text, join_text
from lureline.operators.facts import event_counts, target_pairs


def campaign_texts(campaigns: DataFrame, templates: DataFrame, segments: DataFrame) -> DataFrame:
    """Per campaign: its template's texts (cleaned once per template) and existing ids."""
    tpl = templates.select(
        F.col("id").alias("_tid"),
        F.col("subject").alias("template_subject"),
        F.col("description").alias("template_description"),
        html_to_text("html_body").alias("template_html_text"),
    ).withColumn("text_input", join_text("template_subject", "template_description",
                                         "template_html_text"))
    seg = segments.select(F.col("id").alias("_sid"))
    keys = campaigns.select(F.col("id").alias("campaign_id"), F.col("template_id").alias("_tk"),
                            F.col("segment_id").alias("_sk"))
    return (keys.join(tpl, F.col("_tk") == F.col("_tid"), "left")
                .join(seg, F.col("_sk") == F.col("_sid"), "left"))


def text_fact(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
              targets: DataFrame, event_log: DataFrame) -> DataFrame:
    """Campaign x target with subject, description, visible HTML text, joined text, click flag.

    Narrow pairs are joined with the click counts first; the HTML is cleaned once per template and
    the texts are attached last, so no text column is sorted or shuffled with the fan-out.
    """
    dim = campaign_texts(campaigns, templates, segments)
    out = target_pairs(campaigns, targets).join(
        event_counts(event_log).select("campaign_id", "target_id", "clicked"),
        ["campaign_id", "target_id"], "left").join(dim, "campaign_id")
    missing = F.col("_tid").isNull()
    return out.select(
        "campaign_id",
        F.col("_sid").alias("segment_id"),
        "target_id",
        F.col("_tid").alias("template_id"),
        F.when(missing, F.lit("")).otherwise(F.col("template_subject")).alias("template_subject"),
        F.when(missing, F.lit("")).otherwise(F.col("template_description")).alias("template_description"),
        F.coalesce(F.col("template_html_text"), F.lit("")).alias("template_html_text"),
        F.coalesce(F.col("text_input"), join_text(F.lit(""), F.lit(""), F.lit(""))).alias("text_input"),
        (F.coalesce(F.col("clicked"), F.lit(0)) > 0).cast("int").alias("clicked_flag"),
    )


def page_text(pages: DataFrame) -> DataFrame:
    """C2 over raw pages: visible text per page."""
    return pages.select("page_id", html_to_text("html").alias("text"))


# ---- N2: text classifier (re-aimed from a single-GPU transformer fine-tune) -------------------
def text_classifier_pipeline(text_col: str = "text", label_col: str = "label",
                             num_features: int = 1 << 18, reg: float = 0.0):
    """Whole-text pipeline: unicode word tokens -> hashed term counts -> IDF -> logistic regression.

    Every stage is a distributed Spark ML transformer/estimator; texts are never truncated.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"(?U)\W+", toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_tfidf")
    lr = LogisticRegression(featuresCol="_tfidf", labelCol=label_col, regParam=reg, maxIter=100)
    return Pipeline(stages=[tok, tf, idf, lr])


def train_text_classifier(df: DataFrame, text_col: str, label_col: str, model_name: str,
                          test_size: float = 0.3, seed: int = 42, keys=("doc_id",),
                          min_rows: int = 20) -> DataFrame:
    """Guards (>= min_rows, two classes), keyed stratified split, fit, metrics on the test split."""
    from lureline.operators import evaluation, models

    data = df.select(*keys, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                     F.col(label_col).cast("int").alias("label")).dropna(subset=["label"])
    models.check_trainable(data, label="label", min_rows=min_rows)
    # a keyed hash per row: no text is sorted, shuffled or written
    split = models.stratified_split(data, label="label", test_size=test_size, seed=seed, keys=keys, exact=False)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    model = models.without_summaries(text_classifier_pipeline(label_col="label").fit(train))
    scored = model.transform(test).select(
        F.col("label").alias("y"), vector_to_array("probability")[1].alias("p"))
    return evaluation.model_metrics(scored, model_name, materialize=True)

