"""License scans: a trained paragraph classifier confirmed by template comparison, with DataFrame functions only.

A paragraph ends at a blank line or where a line ends a sentence, so notices that are wrapped over lines are one
paragraph. What is classified is a passage of it: from the first to the last run of three words that a template has, with
a few words around; a gap of more than ``GAP`` words starts another passage. Text without any such run is no candidate,
and loses nothing by that: confirmation asks for half of the smaller side's runs, so it could not be confirmed.

Sparse counts of words and word pairs are hashed and fed to a multinomial logistic regression over licence families and
an `unknown` class. It is trained on the templates below, their parts, and the corpus: every paragraph without such a run
is `unknown`, half of them as the passage around a stray run of words that several families share. The words of a paragraph
deal it to training or calibration, so the probability of being any family is calibrated on rows that training never sees,
copies included. A passage that reaches it is confirmed if enough word trigrams of the passage or of one of its family's
templates are common to both.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import xxhash
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphloom.llm.tables import table
from graphloom.plans import cut
from graphloom.plans.numbering import cumulated

UNKNOWN = "unknown"
FEATURES = 1 << 13
SEED = 5
#: Bits of the numbers that words and pairs are hashed to before they are hashed to features.
CODE = (1 << 31) - 1
#: MB of the regression's blocks of rows: each is added to a matrix of all coefficients apart, so small ones cost more.
BLOCK_MB = 4.0
#: Rows of the regression that one task takes, unless there are fewer tasks than cores: each task sends all coefficients' sums.
TASK_ROWS = 100_000
#: Least calibrated probability of being a licence, and share of the calibration rows that may lie above it.
LEAST_PROBABILITY = 0.5
FALSE_SHARE = 0.005
#: Digits of probabilities that are told and judged: sums over the corpus come in any order, so the last ones vary.
DIGITS = 6
#: Weights of a sentence that states no licence and, at most, of a corpus paragraph in training; parts of licences have 1.
OTHERS_WEIGHT = 2.0
PARAGRAPH_WEIGHT = 0.2
#: Weight of all corpus paragraphs in training, at most, so that a large corpus does not outweigh the licences.
CORPUS_WEIGHT = 200.0
#: Share of common trigrams, of the smaller side, from which a template confirms.
SIMILARITY = 0.5
#: Words between two runs of template words that part passages, and words kept around a passage.
GAP = 12
AROUND = 3
#: Words of the template parts that are trained on, besides whole templates and sentences.
PART = 12
WORD = "[a-z0-9+]+(?:[.-]+[a-z0-9+]+)*"
HYPHENATED = "-[ \\t]*\\r?\\n[ \\t]*"
#: A blank line, or a line that ends a sentence, ends a paragraph.
BREAK = "\\r?\\n[ \\t\\r]*(?=\\n)|(?<=[.!?])[ \\t]*\\r?\\n"
#: The same breaks; characters that begin none are passed over at once.
GUARDED_BREAK = "(?=[ \\t\\r\\n])(?:" + BREAK + ")"

#: Wording of public licences, their notices, grants and disclaimers.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license. See LICENSE file in the project root for details."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "Licensed under the GPL, version 2 or later."),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. For more information, please refer to "
        "https://unlicense.org",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0"),
    ("cc0", "Licensed under CC0 1.0 Universal, public domain dedication."),
    (
        "mit",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
        "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    (
        "isc",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "apache",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
        "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, "
        "publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or "
        "Object form.",
    ),
    (
        "gpl",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for "
        "most software and other practical works are designed to take away your freedom to share and change the works. By "
        "contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions "
        "of a program to make sure it remains free software for all its users.",
    ),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without written permission."),
    ("proprietary", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited; all rights reserved."),
)
#: Sentences with words and phrases of licences that state none.
OTHERS = (
    "The officer asked for her driver's license and the registration of the car.",
    "They applied for a license to sell fish at the market.",
    "He asked his mother for permission to leave the table.",
    "The police searched the house without a warrant.",
    "The warranty of the washing machine ended last year.",
    "An essay on the history of copyright in the nineteenth century.",
    "The Apache rode north before the winter came.",
    "The gnu crossed the river with thousands of others.",
    "The company wants to redistribute the profits among its workers.",
    "Students need permission from the school to park here.",
    "A new law on copyright was debated in parliament.",
    "The book has long been in the public domain.",
    "The seller gave an implied warranty of merchantability, and the jury found it breached.",
    "Whether a boiler is of merchantable quality and fit for a particular purpose is for the judge to say.",
    "Fitness for a particular purpose is measured by what the buyer told the seller.",
    "In no event shall the council be liable for damages caused by the flood, the mayor wrote.",
    "The lender was liable for loss of profits and business interruption under the contract.",
    "The tenant had the prior written permission of the owner to paint the door.",
    "His claim arose out of or in connection with the sale of the farm.",
    "Unless required by applicable law the minutes of the meeting are not published.",
    "The union negotiated the terms and conditions of the new contract.",
    "The names of its contributors were printed at the end of the volume.",
    "The car was sold as is, without warranty of any kind, and broke down on the way home.",
    "Bread was given free of charge to any person who asked for it.",
    "She had the freedom to share and change the recipes of her aunt.",
)
#: Phrases of the law that prose has as well.
PHRASES = (
    "implied warranty of merchantability",
    "merchantability or fitness for a particular purpose",
    "of merchantability and fitness",
    "fit or unfit for a particular purpose",
    "in no event liable for",
    "be liable for any damages",
    "as is and without warranty of any kind",
    "express or implied warranties",
    "free of charge to any person",
    "without prior written permission",
    "arising out of or in connection with",
    "unless required by applicable law",
    "subject to the terms and conditions",
    "loss of use, data or profits",
    "whether in contract, tort or otherwise",
    "all copies or substantial portions",
    "freedom to share and change",
)


def _words(text: Column) -> Column:
    """Lower-case runs of letters, digits and pluses, joined by dots and dashes; a dash at a line's end joins lines."""
    joined = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, HYPHENATED, "-")).otherwise(text)
    return F.regexp_extract_all(F.lower(joined), F.lit(WORD), F.lit(0))


def _runs(words: Column) -> Column:
    """All word trigrams in order; the whole sequence where it is shorter, nothing where there is no word."""

    def of(bound: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(bound) - 2, F.lit(1)))
        some = F.transform(places, lambda i: F.array_join(F.slice(bound, i, 3), " "))
        return F.when(F.size(bound) > 0, some).otherwise(F.array().cast("array<string>"))

    # the outer transform binds the words, which would else be made again for each trigram
    return F.get(F.transform(F.array(words), of), F.lit(0))


def plain_words(text: str) -> list[str]:
    """The words of a template, as ``_words`` finds them."""
    return re.findall(WORD, re.sub(HYPHENATED, "-", text).lower())


def plain_runs(text: str) -> set[str]:
    words = plain_words(text)
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


#: Every trigram of a template.
TEMPLATE_RUNS = sorted(set().union(*(plain_runs(t) for _, t in TEMPLATES)))
#: Those that several families have.
SHARED_RUNS = sorted(
    r for r in TEMPLATE_RUNS if len({family for family, text in TEMPLATES if r in plain_runs(text)}) > 1
)


#: The first, second and third words of template runs: only where all stand is a trigram made and looked up.
RUN_WORDS = [sorted({(r.split(" ") + ["", ""])[k] for r in TEMPLATE_RUNS}) for k in range(3)]
#: Whether a paragraph has a template's run.
HIT = "size(hits) > 0"
#: What is put into corpus paragraphs that are trained and calibrated on as `unknown`; phrases count as often as runs.
STRAY = SHARED_RUNS + list(PHRASES) * max(1, len(SHARED_RUNS) // len(PHRASES))


def _literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _hits(words: Column) -> Column:
    """The places, from 0, of the runs that a template has."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0)))

    def known(i: Column) -> Column:
        likely = F.get(words, i).isin(RUN_WORDS[0])
        for k in (1, 2):
            likely = likely & F.coalesce(F.get(words, i + k), F.lit("")).isin(RUN_WORDS[k])
        return likely & F.array_join(F.slice(words, i + 1, 3), " ").isin(TEMPLATE_RUNS)

    return F.filter(places, known)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, words, hits): every paragraph, numbered from 0, and the places of its template runs."""

    # no filter here: it would be pushed below the words and make them again
    parts = docs.select("doc_id", F.posexplode(F.split("text", GUARDED_BREAK)).alias("paragraph", "part"))
    found = parts.select("doc_id", "paragraph", _words(F.col("part")).alias("words"))
    return found.select("doc_id", "paragraph", "words", _hits(F.col("words")).alias("hits"))


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, place, words): the passages with template words, numbered by paragraph from 0, then by place."""
    # written first: a filter on the hits would be pushed below the words, and make them again for each place
    return _passages(cut(paragraphs(docs), "paragraphs").where(HIT))


def _passages(parts: DataFrame) -> DataFrame:
    kind = "array<struct<a:int,b:int>>"

    def step(spans: Column, at: Column) -> Column:
        last = F.element_at(spans, -1)
        grown = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(F.struct(last["a"].alias("a"), at.alias("b"))))
        new = F.concat(spans, F.array(F.struct(at.alias("a"), at.alias("b"))))
        return F.when((F.size(spans) > 0) & (at - last["b"] <= GAP + 3), grown).otherwise(new).cast(kind)

    spans = F.aggregate("hits", F.array().cast(kind), step)
    each = parts.select("doc_id", "paragraph", "words", F.posexplode(spans).alias("place", "s"))
    start = F.greatest(F.col("s.a") - AROUND, F.lit(0))
    size = F.col("s.b") + 3 + AROUND - start
    return each.select("doc_id", "paragraph", "place", F.slice("words", start + 1, size).alias("words"))


def _labelled(spark: SparkSession) -> DataFrame:
    """Templates, their sentences, halves and windows by family, and the sentences and phrases that state no licence."""
    rows = []
    for family, text in TEMPLATES:
        words = text.split()
        parts = {text, text.lower()} | {x for x in text.split(". ") if len(x.split()) > 6}
        if len(words) > 20:
            parts |= {" ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])}
            parts |= {" ".join(words[i : i + PART]) for i in range(0, len(words) - PART // 2, PART // 2)}
        rows += [(family, p) for p in sorted(parts)]
    rows = [(family, text, 1.0) for family, text in rows] + [(UNKNOWN, t, OTHERS_WEIGHT) for t in OTHERS + PHRASES]
    return spark.createDataFrame(rows, "family string, text string, weight double")


def _negative(h: Column, words: Column) -> Column:
    """What is trained and calibrated on of a paragraph without a template's run, by the hash of its words.

    Every second one is the passage around a run of words that several families share, or around a phrase of the law, that
    is put in at a hashed place, as prose has them; the others are whole.
    """
    runs = _literal([" ".join(plain_words(x)) for x in STRAY])
    stray = F.split(F.get(runs, F.pmod(F.xxhash64(h, F.lit(2)), F.lit(len(STRAY))).cast("int")), " ")
    at = F.pmod(F.xxhash64(h, F.lit(1)), F.size(words) + 1).cast("int")
    before = F.slice(words, F.greatest(at - AROUND, F.lit(0)) + 1, F.least(at, F.lit(AROUND)))
    mixed = F.concat(before, stray, F.slice(words, at + 1, F.lit(AROUND)))
    return F.when(F.pmod(h, F.lit(4)) < 2, mixed).otherwise(words)


def _read(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, hits, own, h, words): every paragraph, under a hash of its words; h is null where it has none.

    ``own`` is what passages are cut from where a template's run is; elsewhere ``words`` is the negative.
    """
    h = F.when(F.size("words") > 0, F.xxhash64("words", F.lit(SEED)))
    rows = paragraphs(docs).select("doc_id", "paragraph", "hits", h.alias("h"), F.col("words").alias("own"))
    negative = F.when(F.expr(HIT), F.array().cast("array<string>")).otherwise(_negative(F.col("h"), F.col("own")))
    return rows.select("doc_id", "paragraph", "hits", F.when(F.expr(HIT), F.col("own")).alias("own"), "h", negative.alias("words"))


def _sampled(docs: DataFrame, size: int) -> DataFrame:
    """(h, text): the first ``size`` negatives by hash, to look at; training takes them all."""
    rows = cut(_read(docs), "negatives").where(f"h IS NOT NULL AND NOT {HIT}").select("h", F.array_join("words", " ").alias("text"))
    return rows.orderBy("h", "text").limit(size)


def _code(gram: str) -> int:
    """The number that Spark makes of a word, or of two words parted by a space."""
    return reduce(lambda seed, word: xxhash.xxh64_intdigest(word.encode(), seed), gram.split(" "), 42) & CODE


class GramHashing(HashingTF):
    """Hashes the codes of words and pairs; the feature of a word, or of two words parted by a space, is ``indexOf``."""

    def indexOf(self, term: str) -> int:
        return super().indexOf(_code(term))


def _grams(code: str) -> str:
    """SQL: ``code`` of the hash of each word, then of each pair; neither is made as a string."""
    ones = f"transform(words, w -> {code.format(f'CAST(xxhash64(w) & {CODE} AS INT)')})"
    pair = code.format(f"CAST(xxhash64(get(words, i), w) & {CODE} AS INT)")
    return f"concat({ones}, transform(slice(words, 2, size(words)), (w, i) -> {pair}))"


def _counting() -> PipelineModel:
    """Words to hashed counts of words and pairs."""
    return PipelineModel(
        [
            SQLTransformer(statement=f"SELECT *, {_grams('{}')} AS codes FROM __THIS__"),
            GramHashing(numFeatures=FEATURES, binary=True, inputCol="codes", outputCol="features"),
        ]
    )


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, hits, words, h, features): all paragraphs with words, written once.

    Passages are cut from ``words`` where a template's run is; ``features`` are those of the negatives elsewhere.
    """
    # what the hashing stage makes of the codes, in the layout that vectors have in Parquet; FEATURES is a power of two, and
    # its remainder is taken by bits, as that is never null and so sorted as plain numbers
    places = F.expr(_grams(f"(hash({{}}) & {FEATURES - 1})"))
    rows = _read(docs).withColumn("places", F.sort_array(F.array_distinct(places)))
    ones = F.array_repeat(F.lit(1.0), F.size("places"))
    layout = [F.lit(0).cast("byte").alias("type"), F.lit(FEATURES).alias("size"), F.col("places").alias("indices"), ones.alias("values")]
    rows = cut(rows.select("doc_id", "paragraph", "hits", F.col("own").alias("words"), "h", F.struct(*layout).alias("features")), "paragraphs")
    schema = StructType([*(f for f in rows.schema if f.name != "features"), StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(rows._cut_path).where("h IS NOT NULL")


def _quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile of the column ``id``, between neighbours as ``percentile`` has it; None without rows.

    It is found by running sums over ranges of values; no task takes all of them, as one does for ``percentile``.
    """
    counts = cut(values.groupBy("id").agg(F.count("*").alias("n")), "values")
    size = counts.agg(F.sum("n")).first()[0]
    if not size:
        return None
    place = (size - 1) * share
    low = math.floor(place)
    ends = [F.min(F.when(F.col("before") + F.col("n") > k, F.col("id"))) for k in (low, math.ceil(place))]
    below, above = cumulated(counts, "n").agg(*ends).first()
    return below + (place - low) * (above - below)


def _any_family(labels: list[str]) -> Column:
    """The probability of being any family."""
    return 1.0 - F.get(vector_to_array("probability"), F.lit(labels.index(UNKNOWN)))


def train(docs: DataFrame) -> tuple[PipelineModel, float]:
    """The fitted pipeline and the calibrated least probability of being a licence.

    Trained on the labelled rows and, as `unknown`, on every paragraph of ``docs`` that has words, none of a template's
    runs, and an even hash; calibrated on all such paragraphs with an odd hash.
    """
    return _train(_counted(docs))


def _train(parts: DataFrame) -> tuple[PipelineModel, float]:
    seen, unseen = (parts.where(f"NOT {HIT} AND pmod(h, 2) = {k}") for k in (0, 1))
    size = seen.count()
    weight = min(PARAGRAPH_WEIGHT, CORPUS_WEIGHT / max(1, size))
    labelled = _labelled(parts.sparkSession).withColumn("words", _words(F.col("text"))).coalesce(1)
    counting = _counting()
    rows = counting.transform(labelled).select("family", "features", "weight")
    rows = rows.union(seen.select(F.lit(UNKNOWN), "features", F.lit(weight)))
    rows = rows.coalesce(max(parts.sparkSession.sparkContext.defaultParallelism, size // TASK_ROWS))
    indexer = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(labelled)
    regression = LogisticRegression(maxIter=40, regParam=0.002, elasticNetParam=0.0, weightCol="weight", maxBlockSizeInMB=BLOCK_MB)
    fitted = regression.fit(indexer.transform(rows))
    told = fitted.transform(unseen.select("features")).select(_any_family(indexer.labels).alias("id"))
    tail = _quantile(told, 1.0 - FALSE_SHARE)
    return PipelineModel([indexer, *counting.stages, fitted]), max(LEAST_PROBABILITY, tail or 0.0)


def predict(model: PipelineModel, found: DataFrame) -> DataFrame:
    """Rows with ``words``, the likeliest family other than `unknown`, and the probability of being any family."""
    labels, columns = model.stages[0].labels, found.columns
    rows = found
    for stage in model.stages[1:]:
        rows = stage.transform(rows)
    pairs = F.arrays_zip(vector_to_array("probability").alias("p"), _literal(labels).alias("f"))
    best = F.array_max(F.filter(pairs, lambda x: x["f"] != UNKNOWN))
    return rows.select(*columns, _any_family(labels).alias("probability"), best["f"].alias("family"))


def scan(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, any more columns) to one row per candidate passage.

    Columns: doc_id, paragraph and place (numbers from 0: the paragraph of the text, the passage in it), family
    (`unknown` unless believed and confirmed), predicted (the likeliest family), probability (of any family), similarity
    (to the predicted family's nearest template), confirmed. Null and empty texts have no passages; null ids and repeated
    rows are carried; whole texts are scanned; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    parts = _counted(docs)
    model, least = _train(parts)
    templates = spark.createDataFrame(list(TEMPLATES), "family string, template string")
    templates = templates.withColumn("grams", F.array_distinct(_runs(_words(F.col("template")))))
    templates = F.broadcast(templates.groupBy("family").agg(F.collect_list("grams").alias("templates")))
    rows = predict(model, _passages(parts.where(HIT))).withColumn("grams", F.array_distinct(_runs(F.col("words"))))

    def common(template: Column) -> Column:
        shared = F.size(F.array_intersect(F.col("grams"), template))
        return shared / F.greatest(F.least(F.size("grams"), F.size(template)), F.lit(1))

    similar = F.coalesce(F.array_max(F.transform("templates", common)), F.lit(0.0))
    rows = rows.join(templates, "family").withColumn("similarity", similar)
    probability = F.round("probability", DIGITS)
    confirmed = (probability >= round(least, DIGITS)) & (F.col("similarity") >= SIMILARITY)
    return rows.select(
        "doc_id",
        F.col("paragraph").cast("long").alias("paragraph"),
        F.col("place").cast("long").alias("place"),
        F.when(confirmed, F.col("family")).otherwise(UNKNOWN).alias("family"),
        F.col("family").alias("predicted"),
        probability.alias("probability"),
        "similarity",
        confirmed.alias("confirmed"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
