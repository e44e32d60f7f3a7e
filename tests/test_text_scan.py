"""Text scans that skip work give the results of the plain scan."""

import random

from pyspark.sql import functions as F

from cadenza.functions import text


def _texts(seed):
    rng = random.Random(seed)
    parts = ["a", " ", "Lat Pulldown", "BENCH PRESS", "pull-up", "pullup", "xpull up", ";", "!", "。", "？", "；", "\n", "é", "€", "€?", "锛?", "鐨", "😀", "", "5"]
    return ["", None, ";", "!!a", "a;;b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(400)]


def test_sentences_equal_the_matches(spark):
    df = spark.createDataFrame([(t,) for t in _texts(1)], "t string")
    plain = F.regexp_extract_all("t", F.lit("[^。！？!?；;]+[。！？!?；;]?"), F.lit(0))
    assert df.where(~plain.eqNullSafe(text.split_sentences(F.col("t")))).count() == 0


def test_terms_equal_the_plain_replacement(spark):
    df = spark.createDataFrame([(t,) for t in _texts(2)], "t string")
    plain = F.col("t")
    for term, word in text.TERMS.items():
        plain = F.regexp_replace(plain, f"(?i)(?<![A-Za-z0-9_]){term}(?![A-Za-z0-9_])", word)
    assert df.where(~plain.eqNullSafe(text.translate_terms(F.col("t")))).count() == 0
    assert df.where(plain != F.col("t")).count() > 50


def test_only_texts_with_a_far_sign_are_damaged(spark):
    df = spark.createDataFrame([(t,) for t in _texts(3)], "t string").where(text.damage_score(F.col("t")) > 0)
    assert df.count() > 50 and df.where(~F.col("t").rlike("[\\u20AC-\\uFFFF]")).count() == 0
