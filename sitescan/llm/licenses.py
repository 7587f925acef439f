"""Licence families of paragraphs: sparse logistic regression over word n-grams, confirmed by templates.

The model is small and trained here: on sentences of the templates, each also with words left
out, against all of the corpus' own paragraphs and sentences that only sound like a licence.
It keeps a few hundred n-grams with a weight; all others add nothing. So a text is scored within its
row: its paragraphs' n-grams are looked up in the weights, and only paragraphs with a licence leave the row. A
prediction counts if its probability reaches the calibrated bound, and is confirmed if the paragraph
holds enough of the word pairs of a sentence of that family's template.
"""

import re

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .secrets import let

UNKNOWN = "unknown"
# Of a template sentence's word pairs: from the first part on a paragraph is no sample of the unknown, from the second confirmed.
HALF = 0.5
CONFIRMED = 0.75
# What all paragraphs of the corpus weigh in the training, where a sentence of a template weighs 1.
PLAIN_WEIGHT = 2250.0
# Paragraphs end at blank lines, and where a line ends with a sentence; other line breaks are wrapping.
BREAK = r"\n[ \t\r]*\n|(?<=[.!?:;])[\"')\]]?[ \t\r]*\n"

# Notices and opening sentences of public licences, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
# Sentences that sound like a licence but name none.
LIKE_LICENSES = [
    "All rights reserved.",
    "Licensed premises open daily until late.",
    "You may not use this file.",
    "The driver's license was issued under the old law.",
    "This work is in progress.",
    "Free software and free beer for everyone.",
    "Version 2.0 of the general public report was released.",
    "Permission is required to enter.",
    "Released under pressure.",
    "Copyright holders may contact the editor.",
]
_ALTER = 6


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def pairs(tokens: Column) -> Column:
    """Pairs of neighbouring words; a marked single word if there is only one."""
    alone = F.when(F.size(tokens) > 0, F.array(F.concat(F.lit("^ "), F.get(tokens, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    two = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(tokens) > 1, F.filter(two, lambda x: F.instr(x, " ") > 0)).otherwise(alone)


def grams(tokens: Column) -> Column:
    return F.concat(tokens, pairs(tokens))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, wrapped lines joined."""
    return F.split(F.coalesce(text, F.lit("")), BREAK, -1)


def templates(spark: SparkSession, by_family: dict = TEMPLATES) -> DataFrame:
    """(family, tokens), a row per sentence."""
    rows = [(f, t) for f, texts in by_family.items() for t in texts]
    return spark.createDataFrame(rows, "family string, text string").select("family", words(F.col("text")).alias("tokens"))


def _altered(rows: DataFrame) -> DataFrame:
    """Each sentence of more than four words also with every sixth word left out, from different places on."""
    turn = F.explode(F.sequence(F.lit(-1), F.lit(_ALTER - 1))).alias("turn")
    out = rows.select("label", "tokens", turn).where((F.col("turn") < 0) | (F.size("tokens") > 4))
    kept = F.filter("tokens", lambda x, i: (F.col("turn") < 0) | (i % _ALTER != F.col("turn")))
    return out.select("label", kept.alias("tokens"))


class Model:
    """Bias by class, weights by n-gram and class, and the least probability that counts."""

    def __init__(self, by_family, bias, weights, least):
        self.by_family, self.bias, self.weights, self.least = by_family, bias, weights, least


def _pairs_of(text: str) -> list[str]:
    found = re.findall(r"[^\W_]+", text.lower())
    return [" ".join(x) for x in zip(found, found[1:])]


def likeness(own: Column, sentences: list[str]) -> Column:
    """The highest share of a sentence's word pairs that are among `own`."""
    shares = []
    for text in sentences:
        theirs = list(dict.fromkeys(_pairs_of(text)))
        shares.append(F.size(F.array_intersect(F.array(*map(F.lit, theirs)), own)) / F.lit(max(1, len(theirs))))
    return shares[0] if len(shares) == 1 else F.greatest(*shares)


def train(docs: DataFrame, by_family: dict = TEMPLATES, quantile: float = 0.995, id_col="doc_id", text_col="text") -> Model:
    """Fit on the templates against all paragraphs of the corpus.

    The n-grams looked at are those of the templates and of the sentences that only sound like a licence. Of a
    paragraph only these count, so paragraphs are merged that hold the same ones equally often. All together weigh
    `PLAIN_WEIGHT`, however many they are. Paragraphs that hold half of a template sentence are left out, since they would be
    called unknown. Every fourth paragraph, by hash, is held out to calibrate the unknown class: a prediction counts
    above the `quantile` of what they get, and from one half on.
    """
    spark = docs.sparkSession
    families = list(by_family)
    label = F.coalesce(*(F.when(F.col("family") == f, F.lit(i + 1)) for i, f in enumerate(families))).cast("double")
    known = templates(spark, by_family).select(label.alias("label"), "tokens")
    like = spark.createDataFrame([(t,) for t in LIKE_LICENSES], "text string").select(F.lit(0.0).alias("label"), words(F.col("text")).alias("tokens"))
    sentences = _altered(known).unionByName(_altered(like)).select("label", grams(F.col("tokens")).alias("grams"))
    # From fixed sentences only.
    vocabulary = sorted(r[0] for r in sentences.select(F.explode("grams")).distinct().collect())
    lines = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        F.xxhash64("doc_id", "text").alias("h"), F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "line")
    )
    tokens = words(F.col("line"))
    found = lines.select((F.pmod(F.xxhash64("h", "paragraph"), F.lit(4)) == 0).alias("held"), let(tokens, lambda t: F.when(F.size(t) > 0, F.array_sort(_weighted(t, vocabulary)))).alias("grams"))
    merged = found.where("grams IS NOT NULL").groupBy("grams").agg(F.count_if(~F.col("held")).alias("n"), F.count_if("held").alias("kept"))
    best = likeness(F.col("grams"), [t for texts in by_family.values() for t in texts])
    plain = merged.where(best < HALF).persist(StorageLevel.MEMORY_AND_DISK)
    total = plain.agg(F.sum("n")).first()[0] or 1
    rows = sentences.coalesce(1).withColumn("weight", F.lit(1.0)).unionByName(
        plain.where("n > 0").select(F.lit(0.0).alias("label"), "grams", (F.col("n") * F.lit(PLAIN_WEIGHT / total)).alias("weight"))
    )
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    regression = LogisticRegression(family="multinomial", weightCol="weight", regParam=5e-4, elasticNetParam=0.9, maxIter=60)
    fitted = regression.fit(counter.transform(rows))
    highest = F.array_max(F.slice(vector_to_array("probability"), 2, len(families)))
    held = fitted.transform(counter.transform(plain.where("kept > 0").select("grams", "kept")))
    # Rounded, so that the percentile goes over a million values at most.
    counts = held.groupBy(F.round(highest, 6).alias("p")).agg(F.sum("kept").alias("kept"))
    bound = counts.agg(F.percentile("p", F.lit(quantile), F.col("kept"))).first()[0]
    plain.unpersist()
    weights = {t: [float(x) for x in c] for t, c in zip(counter.vocabulary, fitted.coefficientMatrix.toArray().T) if abs(c).max() > 1e-9}
    return Model(by_family, [float(x) for x in fitted.interceptVector], weights, max(0.5, bound or 0.0))


def _weighted(tokens: Column, weights) -> Column:
    """Those n-grams of `tokens` that have a weight."""
    single = [w for w in weights if " " not in w]
    double = [w for w in weights if " " in w]
    first, second = ({w.split(" ")[i] for w in double} for i in (0, 1))
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    two = F.zip_with(
        F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n),
        lambda a, b: F.when(a.isin(*first) & b.isin(*second), F.concat(a, F.lit(" "), b)),
    )
    alone = F.when(F.size(tokens) == 1, F.array(F.concat(F.lit("^ "), F.get(tokens, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.filter(tokens, lambda w: w.isin(*single)), F.filter(F.concat(two, alone), lambda w: w.isin(*double)))


def _scored(known: Column, model: Model) -> Column:
    """(place, probability) of the likeliest class, 0 being unknown."""
    table = F.create_map(*(x for w, c in model.weights.items() for x in (F.lit(w), F.array(*map(F.lit, c)))))
    add = lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y)
    logits = F.aggregate(known, F.array(*map(F.lit, model.bias)), add)

    def normal(z):
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
        return F.struct((F.array_position(z, top).cast("int") - 1).alias("place"), (1 / total).alias("probability"))

    return let(logits, normal)


def find_licenses(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", alike: float = CONFIRMED) -> DataFrame:
    """doc_id, text_hash, paragraph, family, probability, likeness, confirmed: one row per paragraph with a licence.

    Paragraphs end at blank lines and where a line ends with a sentence, and are numbered from 0; other
    lines are joined. `likeness` is the largest share of word pairs of one of the family's sentences that the paragraph holds.
    Unknown ones give no row, nor do paragraphs without any n-gram that has a weight, null and empty texts. A
    null id stays. Rows that repeat an id and text give their paragraphs once. Columns of `docs` are read by
    name only, so others may have any names; they are left out.
    """
    families = list(model.by_family)
    names = ["doc_id", "text_hash", "paragraph", "family", "probability", "likeness", "confirmed"]
    if not any(" " in w for w in model.weights) or all(" " in w for w in model.weights):
        model = Model(model.by_family, model.bias, {"": [0.0] * len(model.bias), " ": [0.0] * len(model.bias), **model.weights}, model.least)

    def judged(line, i):
        def by_tokens(tokens):
            scored = lambda known: F.when(F.size(known) > 0, _scored(known, model))
            of = let(_weighted(tokens, model.weights), scored)
            return let(of, lambda s: F.struct(i.alias("paragraph"), s["place"].alias("place"), s["probability"].alias("probability"), tokens.alias("tokens")))

        return let(words(line), by_tokens)

    found = F.filter(F.transform(paragraphs(F.col(text_col)), judged), lambda x: (x["place"] > 0) & (x["probability"] >= model.least))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.explode(found).alias("x"))
    rows = rows.dropDuplicates(["doc_id", "text_hash", "x"]).select("doc_id", "text_hash", "x.*")
    family = F.get(F.array(F.lit(UNKNOWN), *map(F.lit, families)), F.col("place"))
    rows = rows.withColumn("family", family).withColumn("own", pairs(F.col("tokens")))
    shared = F.coalesce(*(F.when(F.col("family") == f, likeness(F.col("own"), model.by_family[f])) for f in families))
    return rows.withColumn("likeness", shared).withColumn("confirmed", F.col("likeness") >= alike).select(names)
