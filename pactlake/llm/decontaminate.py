"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Of every run of w consecutive k-grams the one with the smallest hash is kept, in items and documents
alike, so a shared span of w + k - 1 words always shares a kept hash. Fingerprints are joined, and
each hit is extended to the windows around it, which are compared as text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pactlake.llm.tables import row_key, text_key
from pactlake.llm.words import ALNUM, Words, grams, hashes, joined, least, words_of
from pactlake.session import never_broadcast

GRAM = 5
#: Bytes of the items' windows, and of the names of their items, up to which Spark may broadcast them.
SMALL = 16 << 20
_ROWS = 1 << 16


def scheme(spans: list[int]) -> list[tuple[int, int]]:
    """(k, w) of the fingerprints that catch shared spans of each of these lengths: one pair for all
    spans of at least GRAM words, by the shortest of them, and one for each shorter span."""
    long = [s for s in spans if s >= GRAM]
    return ([(GRAM, min(long) - GRAM + 1)] if long else []) + [(s, 1) for s in sorted(spans) if s < GRAM]


def winnowed(w: Words, k: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of the kept k-grams of each row."""
    g = grams(hashes(w), k)
    at = least(g, wide)
    at = at[np.arange(len(at)) + k + wide - 1 <= w.last_of()[: len(at)]]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return g[at].view(np.int64), at


def fingerprints(rows: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, text_key, code, size, at): kept k-grams of each row; at counts words from 0."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for w in words_of(batch.column("text"), ALNUM, lower=True):
                row = w.row_of()
                for k, wide in pairs:
                    code, at = winnowed(w, k, wide)
                    owner = row[at]
                    place = at - w.first[owner]
                    take = pa.array(owner + w.row)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), keys.take(take), pa.array(code),
                         pa.array(np.full(len(at), k, np.int32)), pa.array(place.astype(np.int64))],
                        ["doc_id", "text_key", "code", "size", "at"],
                    )

    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, code bigint, size int, at bigint")


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """(window_text, items): every window of the items, with the ids that have it."""

    def run(batches):
        for batch in batches:
            ids = batch.column("item_id")
            for w in words_of(batch.column("text"), ALNUM, lower=True):
                text, start, end = joined(w)
                start, end = start.tolist(), end.tolist()
                texts, owner = [], []
                for i, n in enumerate(w.counts.tolist()):
                    a, span = int(w.first[i]), min(n, window)
                    for s in range(a, a + n - span + 1) if n else ():
                        texts.append(text[start[s] : end[s + span - 1]])
                        owner.append(w.row + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.binary()).cast(pa.string()), ids.take(pa.array(owner, pa.int64()))],
                    ["window_text", "item"],
                )

    found = items.mapInArrow(run, "window_text string, item string")
    return found.groupBy("window_text").agg(F.collect_set("item").alias("items"))


def _windows_around(rows: DataFrame, spans: list[int], pairs: list[tuple[int, int]]) -> DataFrame:
    """For each row its number of words (start null), and its windows that contain a hit."""
    sizes = {s: next(k for k, wide in pairs if k == min(s, GRAM)) for s in spans}

    def run(batches):
        for batch in batches:
            ids, keys, hits = batch.column("doc_id"), batch.column("text_key"), batch.column("hits")
            for w in words_of(batch.column("text"), ALNUM, lower=True):
                counts = w.counts
                yield _batch(ids, keys, w.row + np.arange(len(counts)), counts, None, None, None)
                hit_rows = [i for i in range(len(counts)) if hits[w.row + i].is_valid]
                if not hit_rows:
                    continue
                text, start, end = joined(w)
                start, end = start.tolist(), end.tolist()
                owner, place, size, texts = [], [], [], []
                for i in hit_rows:
                    a, n = int(w.first[i]), int(counts[i])
                    found = hits[w.row + i].as_py()
                    for span in spans:
                        starts = {
                            s
                            for hit in found
                            if hit["size"] == sizes[span]
                            for s in range(max(0, hit["at"] + sizes[span] - span), min(hit["at"], n - span) + 1)
                        }
                        for s in sorted(starts):
                            owner.append(w.row + i)
                            place.append(s)
                            size.append(span)
                            texts.append(text[start[a + s] : end[a + s + span - 1]])
                            if len(owner) == _ROWS:
                                yield _batch(ids, keys, owner, None, place, size, texts)
                                owner, place, size, texts = [], [], [], []
                yield _batch(ids, keys, owner, None, place, size, texts)

    schema = "doc_id bigint, text_key bigint, n_words bigint, start bigint, span int, window_text string"
    return rows.mapInArrow(run, schema)


def _batch(ids, keys, owner, counts, place, size, texts) -> pa.RecordBatch:
    take, n = pa.array(owner, pa.int64()), len(owner)
    column = lambda values, kind: pa.nulls(n, kind) if values is None else pa.array(values, kind)
    texts = pa.nulls(n, pa.string()) if texts is None else pa.array(texts, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [ids.take(take), keys.take(take), column(counts, pa.int64()), column(place, pa.int64()),
         column(size, pa.int32()), texts],
        ["doc_id", "text_key", "n_words", "start", "span", "window_text"],
    )


def _covered(spans: Column) -> Column:
    """Words under at least one of the (start, span) intervals."""
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(acc, x):
        end = x["start"] + x["span"]
        new = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(acc["end"], x["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, least_share: int = 20) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated), one row per document.

    A window is `window` consecutive words of an item, or the whole of a shorter item. A word inside any
    occurrence of a window is hit; a document is contaminated if it has a hit word and at least one in
    `least_share` words is hit. Rows alike in doc_id and text give one row. Null or empty texts have no
    words; an item without words has no window; an item with a null id hits but is not counted in
    n_items. Columns other than doc_id, item_id and text are not looked at.

    The spans present are at most `window` integers, taken to the driver. No side is broadcast by hint, and windows
    beyond SMALL not at all: Spark takes them for no larger than the items, of which each word begins one.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), text_key().alias("text_key"), "text")
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    texts = _item_windows(items, window)
    size = F.size(F.split("window_text", " "))
    length = F.octet_length("window_text") + F.octet_length(F.array_join("items", ","))
    found = texts.groupBy(size.alias("span")).agg(F.sum(length.cast("bigint")).alias("bytes")).collect()
    spans = sorted(r.span for r in found)
    judged_by_size = (lambda rows: rows) if sum(r.bytes for r in found) <= SMALL else never_broadcast
    pairs = scheme(spans)
    # Every k-gram that a window may keep (w = 1 keeps them all), by the one scheme its span falls under.
    pieces = texts.select(
        F.lit(None).cast("bigint").alias("doc_id"), size.cast("bigint").alias("text_key"),
        F.col("window_text").alias("text"),
    )
    kept = fingerprints(pieces, [(k, 1) for k, _ in pairs]).where(F.col("size") == F.least("text_key", F.lit(GRAM)))
    kept = kept.select("code", "size").distinct()
    found = fingerprints(docs, pairs).join(judged_by_size(kept), ["code", "size"], "left_semi")
    hits = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "size")).alias("hits"))
    hits = hits.select(row_key(key="text_key").alias("_row"), "hits")
    marked = docs.withColumn("_row", row_key(key="text_key")).join(never_broadcast(hits), "_row", "left")
    rows = _windows_around(marked.select("doc_id", "text_key", "text", "hits"), spans, pairs)
    judged = rows.join(judged_by_size(texts), "window_text", "left").where("n_words is not null or items is not null")
    here = F.when(F.col("items").isNotNull(), F.struct("start", F.col("span").cast("bigint").alias("span")))
    result = judged.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(here).alias("_spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"),
    )
    n_hit = F.col("n_hit")
    return (
        result.withColumn("n_hit", _covered(F.col("_spans")))
        .withColumn("n_items", F.size("_items").cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("_items"), ","), 256))
        .withColumn("contaminated", (n_hit > 0) & (n_hit * least_share >= F.col("n_words")))
        .drop("_spans", "_items")
    )


def contamination_report(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """`contamination` for each row of docs: a row listed more than once is reported as often."""
    found = contamination(docs, items, window).withColumn("_row", row_key(key="text_key"))
    listed = docs.select(row_key().alias("_row"))
    return listed.join(found, "_row").drop("_row", "text_key")


def clean(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """The documents, all their columns, that are not contaminated."""
    found = contamination(docs, items, window).where("contaminated")
    found = found.select(row_key(key="text_key").alias("at"))
    # The document's own columns travel in a struct, so that none of them clashes with these.
    rows = docs.select(row_key().alias("at"), F.struct("*").alias("row"))
    return rows.join(found, "at", "left_anti").select("row.*")

