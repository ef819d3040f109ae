"""License scan by diagonal voting.

Hashes of all rolling word pairs of the documents are joined to the places of those pairs in license
templates. A pair at document word i and template word j votes for diagonal i - j; votes are summed by
diagonal, neighbouring diagonals of a template (words put in or left out) are merged, and the words of
the span, from the outermost votes on, are compared with the template's, ends left free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pactlake.llm.tables import row_key, text_key
from pactlake.llm.words import ALNUM, grams, hashes, words_of

GRAM = 2
#: Diagonals this near are merged; spans at least this similar to their template are found.
SLACK = 3
SIMILARITY = 0.9

#: Phrases of which every place is counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wording of licenses and of common notices, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("creative commons attribution", "cc"),
    ("all rights reserved", "all-rights-reserved"),
)


def _codes(texts: pa.Array):
    """(chunk of words, hash of each pair, first word of each pair)."""
    for w in words_of(texts, ALNUM, lower=True):
        code = grams(hashes(w), GRAM)
        at = np.flatnonzero(np.arange(len(code)) + GRAM <= w.last_of()[: len(code)])
        yield w, code[at].view(np.int64), at


def _pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, at, code): every rolling pair of every text."""

    def run(batches):
        for batch in batches:
            for w, code, at in _codes(batch.column("text")):
                owner = w.row_of()[at]
                take = pa.array(owner + w.row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(take), batch.column("text_key").take(take),
                     pa.array((at - w.first[owner]).astype(np.int64)), pa.array(code)],
                    ["doc_id", "text_key", "at", "code"],
                )

    return docs.mapInArrow(run, "doc_id bigint, text_key bigint, at bigint, code bigint")


def template_pairs(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(template, place, code): the places of the pairs in the templates."""
    rows = []
    for _, code, at in _codes(pa.array([text for text, _ in templates], pa.string())):
        break
    lengths = [len(text.split()) for text, _ in templates]
    first = np.concatenate([[0], np.cumsum(lengths)])
    for c, i in zip(code.tolist(), at.tolist()):
        template = int(np.searchsorted(first, i, "right")) - 1
        rows.append((template, i - int(first[template]), c))
    return spark.createDataFrame(rows, "template int, place bigint, code bigint")


def _spans(votes: DataFrame, lengths: list[int], n_phrases: int) -> DataFrame:
    """(doc_id, text_key, template, start, stop) worth a look: for a phrase each diagonal with all its
    votes, for a notice neighbouring diagonals together if they have half of its votes."""
    size = F.get(F.lit(lengths), F.col("template"))
    phrases = votes.where((F.col("template") < n_phrases) & (F.col("votes") == size - GRAM + 1))
    phrases = phrases.select("doc_id", "text_key", "template", F.col("diagonal").alias("start"), (F.col("diagonal") + size).alias("stop"))
    notices = votes.where(F.col("template") >= n_phrases)
    along = Window.partitionBy("doc_id", "text_key", "template").orderBy("low", "diagonal")
    far = (F.abs(F.col("diagonal") - F.lag("diagonal").over(along)) > SLACK) | (
        F.col("low") - F.lag("high").over(along) > SLACK + GRAM
    )
    runs = notices.withColumn("far", F.coalesce(far, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("far").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "text_key", "template", "run").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").alias("start"), (F.max("diagonal") + F.max(size)).alias("stop"), F.max(size).alias("size")
    )
    merged = merged.where(2 * F.col("votes") >= size - GRAM + 1)
    # Edits before the first vote and after the last move the ends.
    more = F.floor(F.col("size") * (1 - SIMILARITY)).cast("bigint")
    return phrases.union(
        merged.select("doc_id", "text_key", "template", F.greatest(F.col("start") - more, F.lit(0)), F.col("stop") + more)
    )


def aligned(template: list[str], words: list[str]) -> tuple[float, int, int]:
    """(similarity, start, stop) of the part of `words` most like the template (Sellers, 1980): of the
    parts with the fewest edits up to a word that with the highest similarity, then the nearest length,
    then the first."""
    size = len(template)
    best = (0.0, -size, 0, 0)
    # For each prefix of the template the fewest edits to a part that ends here, and where that starts.
    cost, begin = list(range(size + 1)), [0] * (size + 1)
    for i, word in enumerate(words):
        cost, last = [0], cost
        begin, since = [i + 1], begin
        for j, other in enumerate(template):
            least, start = last[j] + (word != other), since[j]
            if last[j + 1] + 1 < least:
                least, start = last[j + 1] + 1, since[j + 1]
            if cost[j] + 1 < least:
                least, start = cost[j] + 1, begin[j]
            cost.append(least)
            begin.append(start)
        length = i + 1 - begin[size]
        alike = 1 - cost[size] / max(size, length)
        best = max(best, (alike, -abs(length - size), -begin[size], i + 1))
    return best[0], -best[2], best[3]


def scan(
    spark: SparkSession,
    docs: DataFrame,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    notices: tuple[tuple[str, str], ...] = NOTICES,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row.

    n_base counts the places of all phrases, first_word and last_word are their smallest and largest
    start; labels are distinct, sorted and joined by commas; score is the similarity of the best span, 0
    without any; spans are (start, stop, label, similarity). A null text counts as empty. Phrases and
    notices are lower-case words joined by one space, each of at least two words; they are a literal
    argument, and their pairs are broadcast.
    """
    templates = [*phrases, *notices]
    words = [text.split() for text, _ in templates]
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), "text")
    hits = _pairs(named).join(F.broadcast(template_pairs(spark, templates)), "code")
    # A row that is listed more than once votes once.
    hits = hits.select("doc_id", "text_key", "template", "at", "place").distinct()
    votes = hits.groupBy("doc_id", "text_key", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    spans = _spans(votes, [len(w) for w in words], len(phrases)).groupBy("doc_id", "text_key")
    spans = spans.agg(F.collect_list(F.struct("template", "start", "stop")).alias("_spans"))
    spans = spans.select(row_key(key="text_key").alias("_row"), "_spans")
    schema = (
        "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<struct<start: bigint, stop: bigint, label: string, similarity: double>>"
    )

    @F.arrow_udf(schema)
    def verify(texts: pa.Array, candidates: pa.Array) -> pa.Array:
        rows = []
        for w in words_of(texts, ALNUM, lower=True):
            for i, n in enumerate(w.counts.tolist()):
                row = {"n_words": n, "n_base": 0, "base_labels": "", "labels": "", "score": 0.0, "spans": []}
                found = candidates[w.row + i]
                if found.is_valid:
                    a = int(w.first[i])
                    bounds = list(zip(w.start[a : a + n].tolist(), w.end[a : a + n].tolist()))
                    base = []
                    for span in sorted(found.as_py(), key=lambda s: (s["start"], s["template"])):
                        t, stop = span["template"], min(span["stop"], n)
                        here = [w.buf[s:e].tobytes().decode() for s, e in bounds[span["start"] : stop]]
                        start = span["start"]
                        if t < len(phrases):
                            alike = float(words[t] == here)
                        else:
                            alike, low, high = aligned(words[t], here)
                            start, stop = start + low, start + high
                        if alike < (1 if t < len(phrases) else SIMILARITY):
                            continue
                        label = templates[t][1]
                        row["spans"].append({"start": start, "stop": stop, "label": label, "similarity": alike})
                        if t < len(phrases):
                            base.append((span["start"], label))
                    if base:
                        starts = [s for s, _ in base]
                        row |= {"n_base": len(base), "first_word": min(starts), "last_word": max(starts)}
                        row["base_labels"] = ",".join(sorted({label for _, label in base}))
                    row["labels"] = ",".join(sorted({s["label"] for s in row["spans"]}))
                    row["score"] = max((s["similarity"] for s in row["spans"]), default=0.0)
                rows.append(row)
        return pa.array(rows, kind)

    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("similarity", pa.float64())])
    whole = [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
    texts = [(c, pa.string()) for c in ("base_labels", "labels")]
    kind = pa.struct([*whole, *texts, ("score", pa.float64()), ("spans", pa.list_(span))])
    marked = docs.select("doc_id", "text").withColumn("_row", row_key()).join(spans, "_row", "left")
    return marked.withColumn("_found", verify("text", "_spans")).select("doc_id", "_found.*")
