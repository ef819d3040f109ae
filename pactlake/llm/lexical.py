"""Ranked lexical search without an index: one Aho-Corasick automaton of all item terms reads the documents.

The automaton holds each term with a guard on either side, over a text in which everything between terms is
guards, so it reports whole terms only, and neighbours share a guard. Its outputs are term numbers, which map
to the items that hold the term. The first pass counts documents and term frequencies, the second scores each
document for the items its terms lead to and keeps a task's best of each item; Spark ranks those.

Automata are broadcast, so they are bounded: items are dealt into blocks of at most about ITEM_BYTES of text
(one longer item is a block), and each block reads the documents on its own.

Documents: null and empty texts have no terms and never score; each row ranks, also one listed again; of equal
scores the smaller doc_id is first, null last. Items: rows alike in item_id and text are one item, other rows
of an item_id are ranked by themselves; an item without terms, or whose terms no document holds, has no rows.
Of extra columns nothing is read. Terms are compared as bytes, so results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter
from types import SimpleNamespace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pactlake.llm.simhash import runs
from pactlake.llm.tables import text_key
from pactlake.llm.words import ALNUM, LOWER, text_chunks

TOP = 10
#: The most text of items in one automaton.
ITEM_BYTES = 4 << 20
#: Scores held at a time: documents times items.
SCORES = 1 << 20
#: Products of a term's weight and its items handled at a time.
_PRODUCTS = 1 << 20

#: Terms are [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ with A-Z lower-cased; every other byte is a guard.
GUARDED = np.where(ALNUM[LOWER], LOWER, 0x20).astype(np.uint8)


def guarded(texts: pa.Array):
    """(row, text of terms between single-byte guards) of each row; a byte is a character."""
    for row, buf, offsets in text_chunks(texts):
        data = GUARDED[buf].tobytes().decode("latin-1")
        for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            yield row + i, f" {data[low:high]} "


def block_terms(texts: pa.Array) -> SimpleNamespace:
    """What is broadcast for a block of items, in plain types: the automaton of its terms, `size` of them; and of each
    term the items that hold it with their counts, those of term t from first[t] to first[t + 1]."""
    numbers: dict[str, int] = {}
    item, term, count = [], [], []
    for row, text in guarded(texts):
        for word, n in Counter(text.split(" ")).items():
            if word:
                item.append(row)
                term.append(numbers.setdefault(word, len(numbers)))
                count.append(n)
    order = np.argsort(np.array(term, np.int64), kind="stable")
    item, term, count = (np.array(x, np.int64)[order] for x in (item, term, count))
    automaton = None
    if numbers:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for word, number in numbers.items():
            automaton.add_word(f" {word} ", number)
        automaton.make_automaton()
    first = np.searchsorted(term, np.arange(len(numbers) + 1))
    return SimpleNamespace(automaton=automaton, size=len(numbers), items=len(texts), first=first, item=item, count=count)


def found(automaton, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(term, tf) of a guarded text."""
    tf = Counter(map(itemgetter(1), automaton.iter(text))) if automaton else {}
    return np.fromiter(tf.keys(), np.int64, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))


def _scanned(automaton, texts: pa.Array, most: int):
    """(first row, terms in each row, row from 0, term, tf) for up to `most` rows at a time."""
    at, lengths, outputs = 0, [], []
    for _, text in guarded(texts):
        # Split at the guard alone: other characters of the decoded bytes may count as spaces.
        lengths.append(sum(map(bool, text.split(" "))))
        outputs.append(found(automaton, text))
        if len(lengths) == most:
            yield at, *_joined(lengths, outputs)
            at, lengths, outputs = at + most, [], []
    if lengths:
        yield at, *_joined(lengths, outputs)


def _joined(lengths: list, outputs: list) -> tuple:
    row = np.repeat(np.arange(len(outputs)), [len(term) for term, _ in outputs])
    term, tf = (np.concatenate(x) for x in zip(*outputs))
    return np.array(lengths, np.int64), row, term, tf


def statistics(docs: DataFrame, terms) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms in all documents, documents with each of the block's terms), exact."""

    def run(batches):
        block = terms.value
        # The last two places are for the documents and the terms in all of them.
        total = np.zeros(block.size + 2, np.int64)
        for batch in batches:
            for _, lengths, _, term, _ in _scanned(block.automaton, batch.column("text"), 1 << 12):
                total[: block.size] += np.bincount(term, minlength=block.size)
                total[block.size :] += [np.count_nonzero(lengths), lengths.sum()]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    size = terms.value.size
    total = np.zeros(size + 2, np.int64)
    total[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return int(total[size]), int(total[size + 1]), total[:size]


def weights(docs_with_terms: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array(
        [math.floor(1000 * math.log((2 * docs_with_terms + 2) / (2 * n + 1))) for n in df.tolist()], np.int64
    )


class Best:
    """The first `top` documents of each item among those seen so far."""

    def __init__(self, items: int, top: int) -> None:
        self.items, self.top = items, top
        self.least = np.ones(items, np.int64)
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, scores: np.ndarray, doc: np.ndarray, unnamed: np.ndarray, key: np.ndarray) -> None:
        """scores: a row for each document, a column for each item."""
        row, item = np.nonzero(scores >= self.least)
        self.parts.append((item, scores[row, item], unnamed[row], doc[row], key[row]))
        self.held += len(row)
        if self.held > 4 * self.items * self.top + (1 << 16):
            self.cut()

    def cut(self) -> tuple:
        item, score, unnamed, doc, key = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((key, doc, unnamed, -score, item))
        at = runs(item[order])
        nth = np.arange(len(order)) - np.repeat(at[:-1], np.diff(at))
        last = order[nth == self.top - 1]
        self.least[item[last]] = score[last]
        order = order[nth < self.top]
        kept = item[order], score[order], unnamed[order], doc[order], key[order]
        self.parts, self.held = [kept], len(order)
        return kept


def _best_of_tasks(docs: DataFrame, terms, ids, stats: tuple[int, int, np.ndarray], top: int, kind: str) -> DataFrame:
    """(item, item_id, doc_id, text_key, score): each task's best of each item; `item` is its row in the block."""
    n_docs, n_terms, df = stats
    weight = weights(n_docs, df)

    def run(batches):
        block = terms.value
        best = Best(block.items, top)
        each = np.diff(block.first)
        for batch in batches:
            names = batch.column("doc_id")
            unnamed = names.is_null().to_numpy(zero_copy_only=False)
            doc, key = names.fill_null(0).to_numpy(), batch.column("text_key").to_numpy()
            for at, lengths, row, term, tf in _scanned(block.automaton, batch.column("text"), max(1, SCORES // max(1, block.items))):
                # Python integers where the product may pass 64 bits.
                m = np.array([25 + 75 * n * n_docs // max(1, n_terms) for n in lengths.tolist()], np.int64)
                value = weight[term] * (1000000000 * tf // (1000 * tf + 8 * m[row]))
                scores = np.zeros((len(lengths), block.items), np.int64)
                end = np.cumsum(each[term])
                low = 0
                while low < len(term):
                    high = max(low + 1, int(np.searchsorted(end, (end[low - 1] if low else 0) + _PRODUCTS, "right")))
                    n = each[term[low:high]]
                    owner = np.repeat(np.arange(low, high), n)
                    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + block.first[term[owner]]
                    np.add.at(scores, (row[owner], block.item[place]), value[owner] * block.count[place])
                    low = high
                rows = slice(at, at + len(lengths))
                best.add(scores, doc[rows], unnamed[rows], key[rows])
        if best.parts:
            item, score, unnamed, doc, key = best.cut()
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), ids.value.take(pa.array(item)), pa.array(doc, mask=unnamed), pa.array(key), pa.array(score)],
                ["item", "item_id", "doc_id", "text_key", "score"],
            )

    schema = f"item bigint, item_id {kind}, doc_id bigint, text_key bigint, score bigint"
    return docs.mapInArrow(run, schema)


def ranked(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the first `top` documents of each item, with a score above 0."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Dealt by hash, a block of half the size hardly passes the bound.
    blocks = 1 if size <= ITEM_BYTES else math.ceil(2 * size / ITEM_BYTES)
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    best = None
    for number in range(blocks):
        block = items.where(F.col("block") == number).toArrow()
        if not block.num_rows:
            continue
        terms = spark.sparkContext.broadcast(block_terms(block.column("text").combine_chunks()))
        ids = spark.sparkContext.broadcast(block.column("item_id").combine_chunks())
        part = _best_of_tasks(docs, terms, ids, statistics(docs, terms), top, kind)
        part = part.withColumn("block", F.lit(number))
        best = part if best is None else best.union(part)
    if best is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_key")]
    # A task gives ten rows an item; over very many tasks an item's rows are thinned in shares first.
    item = ["block", "item"]
    share = Window.partitionBy(*item, F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(64))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*item).orderBy(*order)))
    return best.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
