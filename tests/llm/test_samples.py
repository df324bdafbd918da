"""What is learned from all rows, and samples that no repeated text can fill or empty."""

import numpy as np

from tidemark.llm import language_id, toxicity


def test_features_are_counted_over_all_texts(spark):
    """A term in 3 % of the toxic texts is a feature though the sampled texts hardly hold it."""
    rows = [(i, f"clean words of number{i % 7}", 0) for i in range(800)]
    rows += [(1000 + i, "awful text" + (" zorgblatter" if i % 33 == 0 else ""), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), settings=toxicity.Settings(max_toxic=40))
    new = spark.createDataFrame([(1, "zorgblatter"), (2, "clean words")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(new, model).collect()}
    data = np.frombuffer(b"zorgblatter", np.uint8)
    bucket = toxicity._features(data, np.array([0, len(data)]))[0]
    assert set(bucket.tolist()) <= set(model.chosen.tolist()) and got[1] >= got[2]


def test_bounds_of_samples():
    """Only labelled rows are bounded; nothing bounds the unlabelled ones."""
    bounds = {k: v for k, v in vars(toxicity.Settings()).items() if k.startswith("max_")}
    assert bounds == {"max_toxic": 3000, "max_features": 2048}


def test_language_of_one_repeated_text(spark):
    rows = [(i, "une seule phrase que tout le monde recopie encore", "fr") for i in range(300)]
    rows += [(1000 + i, f"the house of number {i} and what is there", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, rows_per_language=30)
    got = language_id.identify(df, model).where("lang_pred = lang").count()
    assert got == 600
