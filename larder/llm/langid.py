"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (1 to 3, words bounded by a space) of
a language's labelled texts. A document's own most frequent n-grams are compared with each
profile by out-of-place distance: the sum of the rank differences, with the profile's length for an
n-gram that it lacks. The nearest profile wins, ties go to the smaller name.

Profiles are counted over all labelled rows, each task adding up its own before they are shuffled; every
document is then scored on its whole text.

Defined results: a null text or one without a letter is ``und`` with score 0; without any
labelled row every document is ``und``. Score is 1 - distance / largest possible distance.
A text of any length is counted whole, in slices; repeated rows are judged alike and each counts in a profile; equal distances go to the first language by name;
an empty table gives an empty one, and one without any learned language gives ``und`` throughout; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, release_memory, stored

#: Ranks of a profile and of a document.
RANKS = 400
#: Counts that a task holds before it adds up equal n-grams, and sums from which it passes them on.
HELD = 4_000_000
#: Characters of a text whose n-grams are counted at once.
SLICE = 500_000
#: Low quantile of the labelled scores, the part of it that is enough, and labelled rows from which a length class has its own.
LOW_QUANTILE, LOW_MARGIN, CLASS_ROWS = 0.01, 0.65, 50
UNKNOWN = "und"

Profiles = tuple[list[str], np.ndarray, np.ndarray]


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the letters of a text as integers, and their counts; counted in slices, so that a long text needs little more than its codes."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    code = np.where(_letters()[code], code, np.uint32(32))
    code = code[np.append(True, (code[1:] != 32) | (code[:-1] != 32))]
    keys, counts = [], []
    for s in range(0, len(code), SLICE):
        part = code[s : s + SLICE + 2].astype(np.int64)
        two = (part[:-1] << 21) | part[1:]
        one, two, three = part[:SLICE], two[:SLICE], (two[:-1] << 21) | part[2:]
        key, count = np.unique(np.concatenate((one[one != 32], two, three)), return_counts=True)
        keys.append(key)
        counts.append(count)
    if len(keys) == 1:
        return keys[0], counts[0]
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def ranked(text: str | None) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first, ties by value; empty without a letter."""
    if not text:
        return np.empty(0, np.int64)
    key, count = grams(text)
    if not len(key) or key[0] >= 1 << 21:
        return np.empty(0, np.int64)
    return key[np.argsort(-count, kind="stable")[:RANKS]]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of (lang, text) rows, equal n-grams of a task added up as far as ``HELD`` allows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, ((key, n),) in held.items():
            for s in range(0, len(key), SLICE):
                part = key[s : s + SLICE]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[s : s + SLICE])], ["lang", "gram", "n"])
        held.clear()

    def merge() -> int:
        for lang, parts in held.items():
            held[lang] = [_summed(parts)]
        return sum(len(parts[0][0]) for parts in held.values())

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = grams(text)
            held.setdefault(lang, []).append(found)
            size += len(found[0])
            if size > HELD:
                size = merge()
                if size > HELD // 2:
                    yield from passed_on()
                    size = 0
    merge()
    yield from passed_on()
    release_memory()


def fit(labelled: DataFrame) -> Profiles:
    """Profiles from all rows of ``labelled`` (text, lang): names, sorted n-grams, and rank by n-gram and name."""
    bound_batches(labelled.sparkSession)
    usable = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = usable.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= RANKS).collect()
    names = sorted({r["lang"] for r in top})
    keys = np.array(sorted({r["gram"] for r in top}), np.int64)
    place = np.full((len(keys), len(names)), RANKS, np.int64)
    for r in top:
        place[np.searchsorted(keys, r["gram"]), names.index(r["lang"])] = r["place"] - 1
    return names, keys, place


def predict(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """The nearest profile's name and the score."""
    names, keys, place = profiles
    own = ranked(text)
    if not len(own) or not names:
        return UNKNOWN, 0.0
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    known = keys[at] == own
    theirs = place[at]
    away = np.where(known[:, None] & (theirs < RANKS), np.abs(theirs - np.arange(len(own))[:, None]), RANKS).sum(axis=0)
    best = int(np.argmin(away))
    return names[best], float(1 - away[best] / (RANKS * len(own)))


def language(text: Column, profiles: Profiles) -> Column:
    """struct(lang, score) of a text column."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(column: pa.Array) -> pa.Array:
        found = [predict(t, profiles) for t in column.to_pylist()]
        release_memory()
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    return run(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs`` (doc_id, text, lang)."""
    bound_batches(docs.sparkSession)
    if profiles is None:
        profiles = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return docs.select("doc_id", held_out().alias("held_out"), language(F.col("text"), profiles).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def length_class(text: Column) -> Column:
    """Texts of about the same length, by doublings."""
    return F.floor(F.log2(F.char_length(text) + F.lit(1.0))).cast("int")


def least_scores(judged: DataFrame, p: str = "p") -> dict[str, dict[int | None, float]]:
    """For each language, and length class of enough labelled rows (None for all), the least score of a text in it, from all rows of (text, lang) that ``p`` (see ``language``) has right."""
    right = judged.where((F.col(f"{p}.lang") == F.col("lang")) & (F.col(f"{p}.score") > 0)).select("lang", length_class(F.col("text")).alias("length"), F.col(f"{p}.score").alias("score"))
    out: dict[str, dict[int | None, float]] = {}
    for r in right.cube("lang", "length").agg(F.grouping("length").alias("whole"), F.count("*").alias("n"), F.percentile_approx("score", LOW_QUANTILE, 10000).alias("low")).where("lang is not null").collect():
        if r["whole"] or r["n"] >= CLASS_ROWS:
            out.setdefault(r["lang"], {})[None if r["whole"] else r["length"]] = LOW_MARGIN * r["low"]
    return out


def spoken(docs: DataFrame, least_score: float = 0.02) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language: not ``und``, and no further from its profile than labelled texts are.

    The least score is ``LOW_MARGIN`` of a low quantile of all labelled texts of that language and about that length (of any
    length where they are few), ``least_score`` at least and for a language without such texts. Every text is judged once:
    the result is stored, as the quantiles and the rows kept are both read from it.
    """
    bound_batches(docs.sparkSession)
    profiles = fit(docs.select("text", "lang", "doc_id").where(~held_out()))
    at = "_language"
    while at in docs.columns:
        at += "_"
    found = stored(docs.withColumn(at, language(F.col("text"), profiles)), "judged")
    least = F.lit(least_score)
    for lang, by_length in least_scores(found, at).items():
        own = F.lit(by_length.pop(None))
        for length, low in sorted(by_length.items()):
            own = F.when(length_class(F.col("text")) == length, F.lit(low)).otherwise(own)
        least = F.when(F.col(f"{at}.lang") == lang, F.greatest(own, F.lit(least_score))).otherwise(least)
    return found.where((F.col(f"{at}.lang") != UNKNOWN) & (F.col(f"{at}.score") >= least)).select(*docs.columns)
