"""Best-fit packing of documents into sequences of a fixed number of words, under conflicts.

A document is cut into pieces of `capacity` words; its last piece and any shorter document go, longest
first, into the open bin with the least room that still takes it. A bin never holds two pieces of one
source, nor two of one cluster of copies: it carries a bitmap of each, and the search goes on from the
tightest bin to its successors until one is free of both. Packing is done in groups of a bounded number
of documents dealt by hash, so a hot source is spread over all groups and nothing is packed whole in
one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pactlake.llm.simhash import by_group
from pactlake.llm.tables import row_key, text_key

CAPACITY = 2048
#: Documents packed together, about; a task packs one group at a time.
GROUP = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece, pieces taken in the given order. Sources and clusters are small numbers,
    -1 for none. Bins are kept ordered by room, then by the order they were opened in."""
    rooms: list[tuple[int, int]] = []
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        a = 1 << source if source >= 0 else 0
        b = 1 << cluster if cluster >= 0 else 0
        for at in range(bisect_left(rooms, (size, -1)), len(rooms)):
            room, place = rooms[at]
            if not held_sources[place] & a and not held_clusters[place] & b:
                del rooms[at]
                break
        else:
            room, place = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[place] |= a
        held_clusters[place] |= b
        if room > size:
            insort(rooms, (room - size, place))
        out.append(place)
    return out


def n_words(text: str = "text") -> Column:
    r"""Words [^\x20\x09-\x0D]+ of a text, null as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def copies(text: str = "text") -> Column:
    """A cluster for each text, whatever its case and spacing; texts without words have none."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(words != "", F.xxhash64(words))


def packed(
    docs: DataFrame,
    size: Column | None = None,
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    group: int = GROUP,
) -> DataFrame:
    """(doc_id, text_key, piece, start, n_words, bin, room): one row for each piece of each row of docs.

    size: words of a row (default: of its text), cluster: its copies (default: equal texts but for case
    and spacing). piece counts from 0, start is its first word; room is what its bin has left when all
    is packed. Rows without words are one empty piece, packed like any other. A null source or cluster
    conflicts with nothing. Rows listed more than once are packed as often.
    """
    total = docs.count()
    groups = max(1, -(-total // group))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_key().alias("text_key"),
        F.xxhash64(F.col("source").cast("string")).alias("source_key"),
        F.col("source").isNull().alias("no_source"),
        (copies() if cluster is None else cluster).cast("bigint").alias("cluster"),
        (n_words() if size is None else size).cast("bigint").alias("size"),
    )
    # The place in the scan spreads rows alike in id and text, which a retried scan numbers alike.
    spread = F.xxhash64("doc_id", "text_key", F.monotonically_increasing_id())
    dealt = rows.withColumn("group", F.pmod(spread, F.lit(groups)))
    order = ["group", F.desc(F.col("size") % capacity), "doc_id", "text_key"]

    def run(batches):
        for table in by_group(batches, "group"):
            keys = table.column("group").to_numpy()
            at = 0
            while at < len(keys):
                to = int(keys.searchsorted(keys[at], "right"))
                yield from _packed_group(table.slice(at, to - at), int(keys[at]), capacity)
                at = to

    schema = "doc_id bigint, text_key bigint, piece bigint, start bigint, n_words bigint, bin string, room bigint"
    return dealt.repartition("group").sortWithinPartitions(*order).mapInArrow(run, schema)


def _numbered(values: list, none: list[bool]) -> list[int]:
    seen: dict = {}
    return [-1 if skip else seen.setdefault(v, len(seen)) for v, skip in zip(values, none)]


def _packed_group(table: pa.Table, group: int, capacity: int):
    sizes = table.column("size").to_pylist()
    ids, keys = (table.column(c).to_pylist() for c in ("doc_id", "text_key"))
    sources = _numbered(table.column("source_key").to_pylist(), table.column("no_source").to_pylist())
    clusters = table.column("cluster").to_pylist()
    clusters = _numbered(clusters, [c is None for c in clusters])
    rest = [size % capacity for size in sizes]
    loose = [i for i in range(len(sizes)) if rest[i] or not sizes[i]]
    bins = best_fit([rest[i] for i in loose], [sources[i] for i in loose], [clusters[i] for i in loose], capacity)
    left: dict[int, int] = {}
    for i, b in zip(loose, bins):
        left[b] = left.get(b, capacity) - rest[i]
    of = dict(zip(loose, bins))
    names = ("doc_id", "text_key", "piece", "start", "n_words", "bin", "room")
    out: list[tuple] = []
    opened = max(bins, default=-1) + 1
    for i, size in enumerate(sizes):
        full = size // capacity
        for piece in range(full):
            out.append((ids[i], keys[i], piece, piece * capacity, capacity, f"{group}-{opened}", 0))
            opened += 1
            if len(out) == 50_000:
                yield _rows(out, names)
                out = []
        if i in of:
            out.append((ids[i], keys[i], full, full * capacity, rest[i], f"{group}-{of[i]}", left[of[i]]))
    yield _rows(out, names)


def _rows(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.string() if n == "bin" else pa.int64()) for n, c in zip(names, columns)], list(names)
    )


def sequences(docs: DataFrame, pieces: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(bin, n_words, texts): the text of each bin, its pieces in the order of doc_id and piece. A bin is at
    most `capacity` words, so its pieces are gathered in one row."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    named = docs.select(row_key().alias("_row"), words.alias("_words")).dropDuplicates(["_row"])
    parts = pieces.withColumn("_row", row_key(key="text_key")).join(named, "_row", "left")
    cut = F.array_join(F.slice(F.coalesce("_words", F.array()), (F.col("start") + 1).cast("int"), F.col("n_words").cast("int")), " ")
    parts = parts.select("bin", "n_words", F.struct("doc_id", "text_key", "piece", cut.alias("text")).alias("part"))
    gathered = parts.groupBy("bin").agg(F.sum("n_words").alias("n_words"), F.sort_array(F.collect_list("part")).alias("p"))
    return gathered.select("bin", "n_words", F.array_join(F.transform("p", lambda p: p["text"]), separator).alias("text"))
