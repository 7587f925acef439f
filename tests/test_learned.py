import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from sitescan.operators.classify import train_classifier
from sitescan.operators.learned import LearnedClassifier
from sitescan.plans import profile

SHOP, BLOG = "buy cart price checkout order basket", "diary travel story thoughts photo friends"
SCHEMA = "text string, label string"


@pytest.fixture
def examples(rows):
    """Shops and blogs; one text in ten carries the wrong label."""

    def text(i):
        words = (SHOP, BLOG)[i % 2].split()
        return f"{words[i % 6]} {words[i // 2 % 6]} {words[i // 5 % 6]} n{i}"

    labels = ("E-commerce", "Blog")
    return rows(SCHEMA, *((text(i), labels[(i + (i % 10 == 7)) % 2]) for i in range(400)))


def test_confidence_is_the_share_of_right_answers(examples):
    out = LearnedClassifier.train(examples, features=1 << 10).predict(examples.withColumnRenamed("label", "truth"))
    sure, right = out.agg(F.avg("confidence"), F.avg((F.col("label") == F.col("truth")).cast("int"))).first()
    assert right >= 0.85 and abs(sure / 100 - right) < 0.08
    assert out.columns == ["text", "truth", "label", "confidence"]


def test_a_stored_classifier_answers_alike(examples, tmp_path):
    model = LearnedClassifier.train(examples, features=1 << 10)
    model.save(str(tmp_path / "m"))
    again = LearnedClassifier.load(str(tmp_path / "m"))
    texts = examples.select("text")
    assert sorted(model.predict(texts).collect()) == sorted(again.predict(texts).collect())


def test_odd_rows(rows):
    table = rows(SCHEMA, (None, "a"), ("", "a"), ("x y", "b"), ("x y", "b"), ("z", None), ("long " * 50_000, "a"))
    out = LearnedClassifier.train(table, features=64).predict(table).collect()
    assert len(out) == 6 and all(r["label"] in ("a", "b") and 0 <= r["confidence"] <= 100 for r in out)
    with pytest.raises(ValueError, match="no labelled texts"):
        LearnedClassifier.train(rows(SCHEMA, ("x", None)))
    only = LearnedClassifier.train(rows(SCHEMA, ("x", "a"), ("y", "a"))).predict(rows("text string", "q")).first()
    assert only["label"] == "a" and only["confidence"] == 100


def test_in_the_whole_job(examples, rows):
    model = LearnedClassifier.train(examples, features=1 << 10)
    page = "<html><head><title>{}</title></head><body><p>{}</p></body></html>"
    pages = rows("url string, html string", ("https://a.org", page.format("cart", SHOP)), ("https://b.org", page.format("diary", BLOG)))
    out = {r["url"]: r for r in profile.profile_sites(pages, classifier=model).collect()}
    assert out["https://a.org"]["site_type"] == "E-commerce" and out["https://b.org"]["site_type"] == "Blog"
    assert all(r["confidence_type"] >= 60 for r in out.values())


def test_in_a_session_that_has_observed_a_table(spark, examples):
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    both = examples.withColumn("label", (F.col("label") == "Blog").cast("double"))
    model = train_classifier(both, features=1 << 8)
    assert {r["prediction"] for r in model.transform(both.drop("label")).collect()} == {0.0, 1.0}
    assert len(LearnedClassifier.train(examples, features=1 << 8).predict(examples.select("text")).collect()) == 400
