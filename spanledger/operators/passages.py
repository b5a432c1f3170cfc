"""Whole passages searched in whole reports: every (passage, report) pair in which the report grounds the passage.

Grounding is containment of matching forms.  Passages that a task can hold are searched in each report where it is read, all
in one pass: no text, word or candidate moves.  A larger set is looked up by words.

A passage of three or more words can only lie in a report that holds each of its
inner words as a word.  Each passage is looked up by the inner word that the fewest reports hold.  Shorter passages may
begin or end inside a word; they are looked up by all words of the reports that end with their first word, or hold it.  A report
with a word that holds a passage of one word grounds it; all other candidates are verified in the text.  No pair of a passage and a report without such a word is ever made.

Word counts are summed before they move.  The reports of a frequent word are dealt by their ids to as many parts as its
count asks for, and the passages that look for the word are copied to these parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.functions.search import Sought, packed
from spanledger.functions.text import matching_form
from spanledger.session import materialize

SCANNED = 32 << 20  # bytes of passages, with EACH more for every one, that the driver and each task may hold
EACH = 64
ROWS = 100_000  # found pairs that leave a task at once, or those of one report
PART = 10_000  # reports of one word that one part of a join may hold
AFFIX = 8  # letters of a word that a short passage is looked up by


def _words(form: Column) -> Column:
    return F.split(form, " ")


def word_counts(forms: DataFrame) -> DataFrame:
    """word, n_reports."""
    return forms.select(F.explode(F.array_distinct(_words(F.col("form")))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_reports"))


def _rarest_words(passages: DataFrame, counts: DataFrame) -> DataFrame:
    inner = F.explode(F.array_distinct(F.slice("words", F.lit(2), F.size("words") - 2)))
    looked_up = passages.filter(F.size("words") >= 3).select("passage_id", inner.alias("word"))
    known = looked_up.join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n_reports", F.lit(0)).alias("n_reports"), "word")).alias("rarest")
    return known.groupBy("passage_id").agg(rarest).select(
        "passage_id", "rarest.word", "rarest.n_reports", F.lit(False).alias("certain")).filter("n_reports > 0")


def _words_around(passages: DataFrame, counts: DataFrame) -> DataFrame:
    """The words of the reports in which a passage of one or two words may begin; one word lies in them for certain."""
    short = passages.filter(F.size("words") < 3).select(
        "passage_id", F.col("words")[0].alias("first"), (F.size("words") == 1).alias("alone"),
        F.least(F.length(F.col("words")[0]), F.lit(AFFIX)).alias("letters"))
    short = short.withColumn("affix", F.when(F.col("alone"), F.substring("first", F.lit(1), F.col("letters")))
                             .otherwise(F.expr("right(first, letters)")))
    lengths = short.select("alone", "letters").distinct()  # 2 x AFFIX rows at most
    last = F.length("word") - F.col("letters") + 1
    places = F.when(F.col("alone"), F.sequence(F.lit(1), last)).otherwise(F.array(last))
    affixes = counts.select("word", "n_reports", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(AFFIX)))).alias("letters"))
    affixes = affixes.withColumn("alone", F.explode(F.array(F.lit(False), F.lit(True))))
    # each affix of a word once, found inside its row: what moves is at most what some passage has the length for
    inside = F.array_distinct(F.transform(places, lambda at: F.substring(F.col("word"), at, F.col("letters"))))
    parts = affixes.join(lengths, ["alone", "letters"], "left_semi").withColumn("affix", F.explode(inside))
    met = parts.join(short, ["alone", "letters", "affix"])
    fits = F.when(F.col("alone"), F.contains("word", "first")).otherwise(F.endswith("word", "first"))
    return met.filter(fits).select("passage_id", "word", "n_reports", F.col("alone").alias("certain"))


def _by_words(asked: DataFrame, reports: DataFrame, part: int) -> DataFrame:
    """Passages looked up by words of the reports."""
    forms = materialize(
        reports.select("case_id", matching_form(F.col("text")).alias("form")).filter("form <> ''")
        .withColumn("report", F.monotonically_increasing_id()), "report-forms")
    counts = materialize(word_counts(forms), "report-words")
    keys = materialize(_rarest_words(asked, counts).unionByName(_words_around(asked, counts))
                       .withColumn("parts", F.ceil(F.col("n_reports") / F.lit(part)).cast("int")), "passage-words")
    wanted = keys.select("word", "parts").distinct()
    held = forms.select("report", "case_id", F.explode(F.array_distinct(_words(F.col("form")))).alias("word")).join(wanted, "word").select(
        "report", "case_id", "word", F.pmod(F.xxhash64("report"), F.col("parts")).cast("int").alias("part"))
    dealt = keys.select("passage_id", "word", "certain", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def pairs(certain: bool) -> DataFrame:
        met = held.join(dealt.filter("certain" if certain else "not certain"), ["word", "part"])
        return met.select("passage_id", "report", "case_id").distinct()

    named = pairs(False).select("passage_id", "report").join(asked.select("passage_id", "passage"), "passage_id")
    verified = forms.join(named, "report").filter(F.contains("form", "passage"))
    return verified.select("passage_id", "case_id").unionByName(pairs(True).select("passage_id", "case_id"))


def _scanned(asked: DataFrame, reports: DataFrame) -> DataFrame:
    """All passages searched in each row of ``reports`` (case_id, text).  As when they are looked up by words, those of one
    word that share a passage_id are one, and a NULL passage_id names only passages of one word."""
    text = F.col("passage").cast("binary")
    several = asked.filter("size(words) > 1 and passage_id is not null").select("passage_id", F.array(text).alias("texts"))
    alone = asked.filter("size(words) = 1").groupBy("passage_id").agg(F.collect_set(text).alias("texts"))
    held = several.unionByName(alone).toArrow()
    ids, texts = (held[c].combine_chunks() for c in ("passage_id", "texts"))
    distinct = texts.flatten().dictionary_encode()
    number = distinct.indices.to_numpy()
    named = np.repeat(np.arange(len(ids)), texts.value_lengths().to_numpy())[np.argsort(number, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(number, minlength=len(distinct.dictionary))))  # of each text's places in named
    shared = asked.sparkSession.sparkContext.broadcast((Sought(*packed(distinct.dictionary)), ids, named, first))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought, ids, named, first = shared.value
        for batch in batches:
            report, text = sought.find(*packed(batch.column(1)))
            many = first[text + 1] - first[text]
            begins = np.flatnonzero(np.diff(report, prepend=-1))
            portion = (np.cumsum(many) // ROWS)[begins]
            cuts = begins[np.flatnonzero(np.diff(portion, prepend=-1))].tolist()
            for a, b in pairwise([*cuts, len(report)]):
                each = many[a:b]
                place = np.arange(each.sum()) + np.repeat(first[text[a:b]] - np.cumsum(each) + each, each)
                row, name = np.divmod(np.unique(np.repeat(report[a:b], each) * len(ids) + named[place]), len(ids))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(name)), batch.column(0).take(pa.array(row))],
                                                 names=["passage_id", "case_id"])

    forms = reports.select("case_id", F.coalesce(matching_form(F.col("text")), F.lit("")).cast("binary").alias("form"))
    schema = T.StructType([T.StructField("passage_id", asked.schema["passage_id"].dataType),
                           T.StructField("case_id", forms.schema["case_id"].dataType)])
    return forms.mapInArrow(search, schema)


def find_passages(passages: DataFrame, reports: DataFrame, *, part: int = PART, scanned: int = SCANNED) -> DataFrame:
    """(passage_id, case_id) of every row of ``reports`` (case_id, text) whose text grounds the passage (passage_id, text).

    Blank and NULL passages are grounded nowhere, as in ``functions.text.grounded``.  Reports that share a case_id are searched
    each on its own; of passages that share a passage_id, name them apart first.  Up to ``scanned`` bytes of passages are
    searched in one pass over the reports, more are looked up by words.
    """
    form = matching_form(F.col("text"))
    asked = materialize(
        passages.select("passage_id", form.alias("passage")).filter("passage <> ''").withColumn("words", _words(F.col("passage"))),
        "passages")
    size = asked.agg(F.sum(F.octet_length("passage") + F.lit(EACH))).first()[0] or 0
    return _scanned(asked, reports) if size <= scanned else _by_words(asked, reports, part)
