"""Substring dedup by prefix-partitioned suffix subtrees, cut at a depth of `window` words.

A suffix matters only down to its first `window` words: two suffixes that share them meet in one
internal node of that depth, the suffix that stands first stays, and the others' words go. So each
suffix is a path of that length, and paths are dealt to groups by a prefix of variable length: up to
the end of the 4-word gram in it that hashes least. Equal paths have equal prefixes, and neighbouring
suffixes of a text mostly end their prefixes with the same gram, so they travel as one row: its 64-bit
hash once, and 56 bits of the hash of each suffix's whole path.

Groups are read sorted by prefix and place, so a task holds the distinct paths of one prefix and no
more; within some megabytes of text equal paths are merged before they are sent, which thins a
passage that very many documents share to a few rows for each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pactlake.llm.simhash import runs
from pactlake.llm.tables import row_key, text_key
from pactlake.llm.words import NOT_SPACE, Words, grams, hashes, joined, least, mixed, words_of

WINDOW = 20
GRAM = 4
#: Bytes kept of a path's hash.
CODE = 7
#: Columns that count a document's words and those of them that go.
COUNTS = ("_n_words", "_n_removed")

_SPAN = "doc_id bigint, text_key bigint, start bigint, n int"
_SCHEMA = f"prefix bigint, {_SPAN}, paths binary"
_NAMES = ["doc_id", "text_key", "start", "n"]


def _paths(w: Words, window: int, gram: int):
    """(word index, prefix, path) of every suffix that has `window` words in its row."""
    h = hashes(w)
    path = grams(h, window)
    valid = np.flatnonzero(np.arange(len(path)) + window <= w.last_of()[: len(path)])
    g = grams(h, gram)
    anchor = least(g, window - gram + 1)[valid]
    return valid, g[anchor], path[valid], anchor


def _spans(*breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs in which each of the arrays goes on: keys stay, the last one steps by 1."""
    *keys, step = breaks
    if not len(step):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = step[1:] != step[:-1] + 1
    for key in keys:
        new |= key[1:] != key[:-1]
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    return first, np.diff(np.concatenate([first, [len(step)]]))


def _suffix_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows of neighbouring suffixes with one prefix (paths), and of suffixes already known to repeat
    (paths null, n of them from start on)."""

    def run(batches):
        for batch in batches:
            unnamed = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            keys = batch.column("text_key").to_numpy()
            for w in words_of(batch.column("text"), NOT_SPACE, lower=False):
                at, prefix, path, anchor = _paths(w, window, gram)
                row = w.row_of()[at]
                none, doc, key = (c[row + w.row] for c in (unnamed, ids, keys))
                place = at - w.first[row]
                order = np.argsort(path, kind="stable")
                same = path[order][1:] == path[order][:-1]
                stay, again = np.ones(len(path), bool), np.zeros(len(path), bool)
                if same.any():
                    doubled = np.zeros(len(path), bool)
                    doubled[order[1:][same]] = doubled[order[:-1][same]] = True
                    i = np.flatnonzero(doubled)
                    i = i[np.lexsort((place[i], key[i], doc[i], none[i], path[i]))]
                    edges = runs(path[i])
                    first = np.repeat(i[edges[:-1]], np.diff(edges))
                    later = first != i
                    stay[i[later]] = False
                    elsewhere = np.zeros(len(i), bool)
                    for c in (none, doc, key, place):
                        elsewhere |= c[i] != c[first]
                    again[i[later & elsewhere]] = True
                yield _batch(none, doc, key, place, *_kept(prefix, path, anchor, row, at, stay))
                marked = np.flatnonzero(again)
                begin, n = _spans(row[marked], at[marked])
                begin = marked[begin]
                spread = mixed(key[begin].view(np.uint64) + place[begin].astype(np.uint64))
                yield _batch(none, doc, key, place, begin, spread, n, None)

    return docs.mapInArrow(run, _SCHEMA)


def _kept(prefix, path, anchor, row, at, stay):
    i = np.flatnonzero(stay)
    begin, n = _spans(row[i], anchor[i], at[i])
    codes = np.ascontiguousarray(path[i].view(np.uint8).reshape(-1, 8)[:, 8 - CODE :])
    offsets = (CODE * np.concatenate([[0], np.cumsum(n)])).astype(np.int32)
    paths = pa.Array.from_buffers(
        pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes.tobytes())]
    )
    return i[begin], prefix[i[begin]], n, paths


def _codes(paths: pa.Array) -> np.ndarray:
    """The codes of rows of paths, one after the other."""
    data = np.frombuffer(b"".join(paths.to_pylist()), np.uint8).reshape(-1, CODE)
    whole = np.zeros((len(data), 8), np.uint8)
    whole[:, :CODE] = data
    return whole.view(np.uint64)[:, 0]


def _batch(none, doc, key, place, begin, prefix, n, paths) -> pa.RecordBatch:
    paths = pa.nulls(len(begin), pa.binary()) if paths is None else paths
    return pa.RecordBatch.from_arrays(
        [pa.array(prefix.view(np.int64)), pa.array(doc[begin], mask=none[begin]), pa.array(key[begin]),
         pa.array(place[begin].astype(np.int64)), pa.array(n.astype(np.int32)), paths],
        ["prefix", *_NAMES, "paths"],
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, start, n): runs of n suffixes, by their first words, whose first `window` words
    also start earlier: at a smaller doc_id (null last; of equal ids, a smaller text_key), or earlier in
    the same document. Rows alike in doc_id and text are one document. doc_id is a bigint here."""

    def run(batches):
        last, seen = None, None
        for batch in batches:
            paths = batch.column("paths")
            known = paths.is_null().to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(~known)
            out = [batch.filter(pa.array(known)).select(_NAMES)]
            if len(rows):
                none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)[rows]
                prefix, doc, key, start, n = (
                    batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)[rows] for c in ("prefix", *_NAMES)
                )
                own = np.repeat(np.arange(len(rows)), n)
                step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                code = _codes(paths.drop_null())
                table = np.stack([none[own].astype(np.int64), doc[own], key[own], start[own] + step])
                group = np.repeat(np.cumsum(np.concatenate([[0], prefix[1:] != prefix[:-1]])), n)
                if last is None or last != prefix[0]:
                    seen = (np.zeros(0, np.uint64), np.zeros((4, 0), np.int64))
                table = np.concatenate([seen[1], table], axis=1)
                code = np.concatenate([seen[0], code])
                group = np.concatenate([np.zeros(len(seen[0]), np.int64), group])
                # One to one for the codes of a group.
                node = mixed(code ^ mixed(group.astype(np.uint64) + np.uint64(1)))
                _, first, inverse = np.unique(node, return_index=True, return_inverse=True)
                head = first[inverse]
                again = (table != table[:, head]).any(axis=0)[len(seen[0]) :]
                hit = np.flatnonzero(again)
                begin, size = _spans(own[hit], step[hit])
                at = hit[begin]
                out.append(
                    pa.RecordBatch.from_arrays(
                        [pa.array(doc[own[at]], mask=none[own[at]]), pa.array(key[own[at]]),
                         pa.array(start[own[at]] + step[at]), pa.array(size.astype(np.int32))],
                        _NAMES,
                    )
                )
                # The paths of the last prefix, which may go on in the next batch.
                last = prefix[-1]
                open_group = first[group[first] == group[-1]]
                seen = (code[open_group], table[:, open_group])
            yield from out

    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), "text")
    rows = _suffix_rows(named, window, gram).repartition("prefix")
    rows = rows.sortWithinPartitions("prefix", F.asc_nulls_last("doc_id"), "text_key", "start")
    return rows.mapInArrow(run, _SPAN)


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents, all their columns; text is what is left of its words, joined by one space, and
    COUNTS are added, in place of columns of those names. Null and empty texts become empty.

    Windows are judged on the input, not on what is left.
    """

    @F.arrow_udf("text string, n_words bigint, n_removed bigint")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out, counts, gone = [], [], []
        for w in words_of(texts, NOT_SPACE, lower=False):
            keep = np.ones(len(w.start), bool)
            for i in range(len(w.counts)):
                found = spans[w.row + i]
                if found.is_valid:
                    at = found.values.field("start").to_numpy()
                    to = at + found.values.field("n").to_numpy() + window - 1
                    edge = np.zeros(w.counts[i] + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, to, -1)
                    keep[w.first[i] : w.first[i + 1]] = np.cumsum(edge)[:-1] == 0
            text, _, end = joined(w, keep)
            left = np.concatenate([[0], np.cumsum(keep)])[w.first]
            edges = np.concatenate([[0], end + 1])[left].tolist()
            out += [text[a : max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:])]
            counts.append(w.counts)
            gone.append(w.counts - np.diff(left))
        whole = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(out, pa.binary()).cast(pa.string()), whole(counts), whole(gone)],
            ["text", "n_words", "n_removed"],
        )

    spans = repeated_spans(docs, window, gram).groupBy("doc_id", "text_key")
    spans = spans.agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    spans = spans.select(row_key(key="text_key").alias("row"), "spans")
    # The document's own columns travel in a struct, so that none of them clashes with these.
    marked = docs.select(row_key().alias("row"), F.struct("*").alias("doc")).join(spans, "row", "left")
    marked = marked.select("doc", cut("doc.text", "spans").alias("cut"))
    columns = [F.col("cut.text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns if c not in COUNTS]
    return marked.select(*columns, *[F.col("cut")[c.removeprefix("_")].alias(c) for c in COUNTS])


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    return dedup(docs.select("doc_id", "text"), window).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
