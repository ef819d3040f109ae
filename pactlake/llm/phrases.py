"""Phrase collocations: exact phrase counts from HAT-tries in tasks, merged per prefix partition.

A text is lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and a piece into words at spaces and
tabs. Within a task phrases are counted in a HAT-trie: a shallow trie of word ids over hash containers that
hold the rest of a path. A container that grows too large bursts into a trie node with a container for each
next word; when the trie is full its largest subtrees leave whole, as sorted runs. Spark deals the runs by
the prefix of their paths and merges them there.

A phrase is at least as rare as its parts, so paths are cut at words and pairs that are too rare: those whose
bit is missing in a bitmap of fixed size, made of the exact counts of the level before. A bit that several
share only lets more paths through, so counts are exact at any size.

A word is named by a 64-bit hash of its language and text. Null, empty and repeated texts: a null text has no
words, each row counts. A null language is `und`.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pactlake.llm.bitmaps import bitmap, marked
from pactlake.llm.simhash import runs
from pactlake.llm.tables import written
from pactlake.llm.words import BYTES, Words, hashes, mixed, words_of

LEAST = 30
LONGEST = 4
TOP = 2000
#: A longer candidate this often, in hundredths of the shorter one's count, makes the shorter one go.
COVERED = 80
#: A container bursts beyond so many paths; the trie gives up subtrees beyond so many paths, and all of them
#: beyond so many words.
BURST, ROOM, IDS = 1 << 12, 1 << 18, 1 << 18
#: Words worked on at a time; a longer text is cut into such pieces.
STEP = 1 << 18

#: [.,;:!?\x0A-\x0D] ends a piece.
BREAK = np.isin(BYTES, [*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D])
#: [^\x20\x09]+ within a piece.
INSIDE = ~(BREAK | (BYTES == 0x20) | (BYTES == 0x09))

_ID = 21
_MASK = (1 << _ID) - 1
_PAIR = np.uint64(0x9FB21C651E98DF25)


class Node(dict):
    """A trie node: the next word's id -> a node, or a container (plain dict: rest of the path -> count)."""


class HatTrie:
    """Counts of paths of up to `depth` words. In a path the ids of the words after the first are packed into one
    integer, 21 bits each, zero after the end."""

    def __init__(self, depth: int, burst: int, room: int) -> None:
        self.depth, self.burst, self.room = depth, burst, room
        self._clear()

    def _clear(self) -> None:
        self.root, self.size = Node(), 0
        self.ids, self.names = {}, [0]

    def number(self, distinct: np.ndarray) -> np.ndarray:
        """The trie's own ids of different words, given by their hashes, from 1."""
        ids, names = self.ids, self.names
        out = []
        for name in distinct.tolist():
            found = ids.get(name)
            if found is None:
                found = ids[name] = len(names)
                names.append(name)
            out.append(found)
        return np.array(out, np.int64)

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        """Count paths, each given by its first id and the others packed."""
        if self.depth == 2:
            both, count = np.unique(first << _ID | rest, return_counts=True)
            first, rest = both >> _ID, both & _MASK
        else:
            order = np.lexsort((rest, first))
            first, rest = first[order], rest[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (first[1:] != first[:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(rest)))
            first, rest = first[at], rest[at]
        at = runs(first)
        self._put(self.root, first[at[:-1]].tolist(), at.tolist(), rest, count, self.depth - 1)

    def _put(self, node: Node, words: list, at: list, rest: np.ndarray, count: np.ndarray, left: int) -> None:
        """Add to the children of a node the paths at[i] to at[i + 1] for words[i]; `left` words are in rest."""
        keys, counts = rest.tolist(), count.tolist()
        for word, low, high in zip(words, at, at[1:]):
            child = node.get(word)
            if child is None:
                child = node[word] = {}
            elif type(child) is Node:
                shift = _ID * (left - 1)
                top = rest[low:high] >> shift
                below = runs(top)
                under = rest[low:high] & ((1 << shift) - 1)
                self._put(child, top[below[:-1]].tolist(), below.tolist(), under, count[low:high], left - 1)
                continue
            before = len(child)
            for i in range(low, high):
                key = keys[i]
                child[key] = child.get(key, 0) + counts[i]
            after = len(child)
            self.size += after - before
            if after > self.burst and left > 1:
                node[word] = self._burst(child, left)

    def _burst(self, container: dict, left: int) -> Node:
        shift = _ID * (left - 1)
        node = Node()
        for key, n in container.items():
            node.setdefault(key >> shift, {})[key & ((1 << shift) - 1)] = n
        return node

    def _flat(self, words: list, children: list, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, rest, count) of all paths of some children of a node."""
        flat = [(word, child) for word, child in zip(words, children) if type(child) is not Node]
        sizes = [len(child) for _, child in flat]
        total = sum(sizes)
        parts = [(
            np.repeat(np.array([word for word, _ in flat], np.int64), sizes),
            np.fromiter(chain.from_iterable(child.keys() for _, child in flat), np.int64, total),
            np.fromiter(chain.from_iterable(child.values() for _, child in flat), np.int64, total),
        )]
        for word, child in zip(words, children):
            if type(child) is Node:
                below, rest, count = self._flat(list(child), list(child.values()), left - 1)
                rest = below << _ID * (left - 1) | rest
                parts.append((np.full(len(rest), word, np.int64), rest, count))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def spill(self, whole: bool):
        """Sorted runs (names of the path's words, counts) of whole subtrees: of all, or of the largest until half
        the room is free. What is given out is gone from the trie."""
        names = np.array(self.names, np.uint64)
        sizes = {word: _paths(child) if type(child) is Node else len(child) for word, child in self.root.items()}
        goal = 0 if whole else self.room // 2
        batch, held = [], 0
        for word in sorted(sizes, key=sizes.get, reverse=True):
            if self.size <= goal:
                break
            batch.append(word)
            held += sizes[word]
            self.size -= sizes[word]
            if held >= 1 << 16:
                yield self._run(names, batch)
                batch, held = [], 0
        if batch:
            yield self._run(names, batch)
        if whole:
            self._clear()

    def _run(self, names: np.ndarray, words: list) -> tuple[list[np.ndarray], np.ndarray]:
        first, rest, count = self._flat(words, [self.root.pop(word) for word in words], self.depth - 1)
        order = np.lexsort((rest, first))
        first, rest, count = first[order], rest[order], count[order]
        ids = [first, *(rest >> _ID * (self.depth - 1 - j) & _MASK for j in range(1, self.depth))]
        return [names[i].view(np.int64) for i in ids], count


def _paths(child: dict) -> int:
    return sum(map(_paths, child.values())) if type(child) is Node else len(child)


def _langs(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(index of each row's language, the languages, their hashes)."""
    langs = batch.column("lang").cast(pa.string()).fill_null("und").dictionary_encode()
    names = langs.dictionary.to_pylist()
    codes = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names]
    return langs.indices.to_numpy(), names, np.array(codes, np.uint64)


def _pieces(w: Words) -> np.ndarray:
    """For each word whether the next one stands in the same piece."""
    at = np.cumsum(BREAK[w.buf])[w.start] if len(w.start) else np.zeros(0, np.int64)
    row = w.row_of()
    same = np.zeros(len(at), bool)
    same[:-1] = (at[1:] == at[:-1]) & (row[1:] == row[:-1])
    return same


def _texts(batches):
    """(words, language index of each, languages, id of each) a bounded number of bytes at a time."""
    for batch in batches:
        lang, names, codes = _langs(batch)
        for w in words_of(batch.column("text"), INSIDE, lower=True):
            of = lang[w.row_of() + w.row]
            ids = mixed(hashes(w) ^ codes[of]) if len(of) else np.zeros(0, np.uint64)
            # Zero ends a path.
            yield w, of, names, np.where(ids == 0, np.uint64(1), ids)


def word_counts(docs: DataFrame) -> DataFrame:
    """(id, lang, word, n) of every word; in the rows with neither id nor word n counts all words of lang."""

    def run(batches):
        for w, of, names, ids in _texts(batches):
            distinct, first, count = np.unique(ids, return_index=True, return_counts=True)
            data = w.buf.tobytes()
            spans = zip(w.start[first].tolist(), w.end[first].tolist())
            words = pa.array([data[a:b] for a, b in spans], pa.binary()).cast(pa.string())
            total = np.bincount(of, minlength=len(names))
            some = np.flatnonzero(total)
            langs = pa.array(names, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(distinct.view(np.int64)), pa.nulls(len(some), pa.int64())]),
                 langs.take(pa.array(np.concatenate([of[first], some]))),
                 pa.concat_arrays([words, pa.nulls(len(some), pa.string())]),
                 pa.array(np.concatenate([count, total[some]]).astype(np.int64))],
                ["id", "lang", "word", "n"],
            )

    rows = docs.select("lang", "text").mapInArrow(run, "id bigint, lang string, word string, n bigint")
    return rows.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def pair_name(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * _PAIR + second)


def path_counts(spark: SparkSession, docs: DataFrame, depth: int, words: np.ndarray, pairs: np.ndarray | None) -> DataFrame:
    """(w1, ..., w`depth`, n), zero after the end of a path: the runs of each task's trie, not merged. Without
    pairs all pairs of marked words; with them every path of at least three words whose pairs are marked, as
    long as it goes."""
    words = spark.sparkContext.broadcast(words)
    pairs = None if pairs is None else spark.sparkContext.broadcast(pairs)
    columns = [f"w{j + 1}" for j in range(depth)]

    def batch_of(names, count):
        return pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(count)], [*columns, "n"])

    def run(batches):
        trie = HatTrie(depth, BURST, ROOM)
        for w, _, _, ids in _texts(batches):
            known = marked(words.value, ids)
            joined = _pieces(w)
            joined[:-1] &= known[:-1] & known[1:]
            if pairs is not None:
                at = np.flatnonzero(joined)
                joined[at] = marked(pairs.value, pair_name(ids[at], ids[at + 1]))
            least = 1 if pairs is None else 2
            start = joined.copy()
            for j in range(1, least):
                start[: len(start) - j] &= joined[j:]
                start[len(start) - j :] = False
            for low in range(0, len(ids), STEP):
                at = np.flatnonzero(start[low : low + STEP])
                if not len(at):
                    continue
                # The words of this step and those that its last paths reach.
                on = joined[low : low + STEP + depth - 1]
                used = on.copy()
                used[1:] |= on[:-1]
                distinct, back = np.unique(ids[low : low + len(on)][used], return_inverse=True)
                if len(trie.names) + len(distinct) > IDS:
                    yield from (batch_of(*x) for x in trie.spill(whole=True))
                number = np.zeros(len(on) + depth, np.int64)
                number[: len(on)][used] = trie.number(distinct)[back]
                on = np.concatenate([on, np.zeros(depth, bool)])
                rest, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
                for j in range(1, depth):
                    alive = alive & on[at + j - 1]
                    rest = rest << _ID | np.where(alive, number[at + j], 0)
                trie.add(number[at], rest)
                if trie.size > trie.room:
                    yield from (batch_of(*x) for x in trie.spill(whole=False))
        yield from (batch_of(*x) for x in trie.spill(whole=True))

    schema = ", ".join(f"{c} bigint" for c in [*columns, "n"])
    return docs.select("lang", "text").mapInArrow(run, schema)


WORDS = ["w1", "w2", "w3", "w4"]


def frequent_phrases(spark: SparkSession, docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals), all with exact counts n: (id, lang, word, n) and (w1, ..., w4, n), zero after the
    end, of what stands at least `least` times, and (lang, n) with all words."""
    counted = word_counts(docs)
    counted = written(spark, "words", counted.where((F.col("n") >= least) | F.col("id").isNull()))
    words, totals = counted.where("id is not null"), counted.where("id is null").select("lang", "n")
    known = bitmap(words, "id")
    pairs = path_counts(spark, docs, 2, known, None).groupBy("w1", "w2").agg(F.sum("n").alias("n"))
    pairs = written(spark, "pairs", pairs.where(F.col("n") >= least))

    @F.arrow_udf("bigint")
    def name(first: pa.Array, second: pa.Array) -> pa.Array:
        first, second = (x.to_numpy(zero_copy_only=False).view(np.uint64) for x in (first, second))
        return pa.array(pair_name(first, second).view(np.int64))

    runs_of = path_counts(spark, docs, 4, known, bitmap(pairs.select(name("w1", "w2").alias("name")), "name"))
    # All runs of a prefix of three words meet in one partition, where both sums are formed.
    prefix = Window.partitionBy("w1", "w2", "w3")
    merged = runs_of.repartition("w1", "w2", "w3").groupBy(*WORDS).agg(F.sum("n").alias("n"))
    merged = merged.select("*", F.sum("n").over(prefix).alias("n3"), F.row_number().over(prefix.orderBy("w4")).alias("nth"))
    four = F.when((F.col("w4") != 0) & (F.col("n") >= least), F.struct("w4", "n"))
    three = F.when(F.col("nth") == 1, F.struct(F.lit(0).cast("bigint").alias("w4"), F.col("n3").alias("n")))
    longer = merged.where(F.col("n3") >= least).select("w1", "w2", "w3", F.explode(F.array(four, three)).alias("of"))
    longer = longer.where("of is not null").select("w1", "w2", "w3", "of.w4", "of.n")
    none = F.lit(0).cast("bigint")
    phrases = longer.union(pairs.select("w1", "w2", none, none, "n"))
    return words, written(spark, "phrases", phrases), totals


def _part(path: list, low: int, high: int) -> list:
    """Words low to high of a path as a path of its own."""
    path = path[low:high]
    return [*path, *[F.lit(0).cast("bigint")] * (LONGEST - len(path))]


def collocations(
    spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language, by score, count and text.

    Candidates are the phrases of 2 to 4 words that stand a >= `least` times. The score is 2,000,000 a / (l + r),
    rounded down, at the cut into two phrases (l and r times) where it is lowest; of equal ones at the first.
    A candidate goes where a longer one around it stands at least `covered` hundredths as often."""
    words, phrases, totals = frequent_phrases(spark, docs, least)
    counts = phrases.union(words.select("id", *[F.lit(0).cast("bigint")] * 3, "n"))
    size = sum((F.col(c) != 0).cast("int") for c in WORDS)
    path = [F.col(c) for c in WORDS]

    # Each cut as (first part, rest).
    def cuts(n: int):
        return F.array(*[
            F.struct(F.lit(k).alias("k"), F.struct(*[x.alias(c) for x, c in zip(_part(path, 0, k), WORDS)]).alias("left"),
                     F.struct(*[x.alias(c) for x, c in zip(_part(path, k, n), WORDS)]).alias("right"))
            for k in range(1, n)
        ])

    of_size = F.when(size == 2, cuts(2)).when(size == 3, cuts(3)).otherwise(cuts(4))
    cut = phrases.select(*WORDS, F.col("n").alias("a"), F.explode(of_size).alias("cut"))
    cut = cut.select(F.struct(*WORDS).alias("path"), "a", "cut.*")
    known = counts.select(F.struct(*WORDS).alias("part"), F.col("n").alias("found"))
    for side, count in (("left", "l"), ("right", "r")):
        cut = cut.join(known.withColumnsRenamed({"part": side, "found": count}), side)
    # Exact beyond 64 bits.
    score = F.expr("cast(2000000 as decimal(8)) * cast(a as decimal(20)) div cast(l + r as decimal(20))")
    scored = cut.withColumn("score", score.cast("bigint")).groupBy("path", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    # The phrases inside a longer one, with the count of the most frequent around each.
    def inner(n: int):
        return F.array(*[
            F.struct(*[x.alias(c) for x, c in zip(_part(path, low, low + m), WORDS)]) for m in range(2, n) for low in range(n - m + 1)
        ])

    around = phrases.where(size > 2).select("n", F.explode(F.when(size == 3, inner(3)).otherwise(inner(4))).alias("path"))
    around = around.groupBy("path").agg(F.max("n").alias("around"))
    hidden = F.expr(f"cast(100 as decimal(4)) * cast(around as decimal(20)) >= cast({covered} as decimal(4)) * cast(a as decimal(20))")
    left = scored.join(around, "path", "left").where(~F.coalesce(hidden, F.lit(False)))

    # Texts.
    spelt = left.select("*", F.posexplode(F.array(*[F.col("path")[c] for c in WORDS])).alias("at", "id")).where("id <> 0")
    spelt = spelt.join(words.select("id", "lang", "word"), "id").groupBy("path", "a", "best", "lang")
    spelt = spelt.agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("said"))
    spelt = spelt.select("lang", F.array_join(F.col("said.word"), " ").alias("phrase"), "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A language may hold most candidates: its first are taken from each of many shares of it, then of those.
    for shares in (1024, 32):
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
        spelt = spelt.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top).drop("rank")
    ranked = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
