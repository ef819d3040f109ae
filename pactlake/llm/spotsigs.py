"""Document fingerprints by SpotSigs (Theobald, Siddharth and Paepcke, 2008), in DataFrame operations only.

A signature is a common word (the anchor) with the chain of content words that follows it, up to
`CHAIN` of them or the next anchor. A text's fingerprint stands for its set of distinct signatures, and
two texts are as alike as the Jaccard similarity of their sets. Sets whose lengths alone rule a
similarity out are not compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pactlake.llm.tables import text_key

#: Content words of a signature, at most.
CHAIN = 3
#: Anchors: common words of English, French, German and Spanish.
COMMON = (
    "a an and are as at be been by for from had has have he her his i in is it its not of on or she that the their "
    "they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour que "
    "qui sa se ses son sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im ist mit nach nicht oder "
    "sich sie sind so und von war wie wir zu zum zur "
    "al como con del el ella en es esta este la las lo los más no para pero por que se ser sin sobre su sus un una y"
)
#: Ranges of ids that neighbours are looked up in, at most.
RANGES = 4096
RANGE_ROWS = 2000


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^0-9a-z\x{80}-\x{10FFFF}]+", " "))


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, by their first letters."""
    rests: dict[str, list[str]] = {}
    for word in words:
        rests.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(r, reverse=True))})" for c, r in sorted(rests.items()))


def with_signatures(
    rows: DataFrame, text: str, name: str, chain: int = CHAIN, common: str = COMMON
) -> DataFrame:
    """Rows with the distinct signatures of a text column as 64-bit hashes, never none: a text without a
    single anchored chain has its words as signatures, a text without words the empty word.

    Each step is a column of its own, so that no text is split more than once.
    """
    anchors = _any_of(sorted(set(common.split())))
    steps = rows.withColumn("_words", _words(F.col(text)))
    pieces = F.split(F.concat(F.lit(" "), "_words"), f" (?=(?:{anchors})(?: |$))")
    steps = steps.withColumn("_pieces", F.slice(pieces, 2, 1 << 30))
    chains = F.transform(
        "_pieces",
        lambda p: F.when(F.instr(p, " ") > 0, F.xxhash64(F.substring_index(p, " ", chain + 1))),
    )
    steps = steps.withColumn("_chains", F.array_distinct(F.array_compact(chains)))
    plain = F.array_distinct(F.transform(F.split("_words", " "), lambda w: F.xxhash64(w)))
    sigs = F.when(F.size("_chains") > 0, F.col("_chains")).otherwise(plain)
    return steps.withColumn(name, sigs).drop("_words", "_pieces", "_chains")


def fingerprint(sigs: Column) -> Column:
    """128 bits of the set, as 32 hex digits: equal sets, and so equal texts, have equal fingerprints."""
    ordered = F.sort_array(sigs)
    half = lambda h: F.lpad(F.hex(h), 16, "0")
    return F.lower(F.concat(half(F.xxhash64(ordered)), half(F.xxhash64(F.lit(1), ordered))))


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without comparing them where their lengths keep it below
    `floor`, as the shorter over the longer is a bound."""
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    return F.when(bound < floor, F.lit(0.0)).otherwise(exact)


def _range_of(doc_id: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds are at most doc_id, by two short look-ups."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    group = below(F.lit([g[0] for g in groups]))
    inside = below(F.get(F.array(*[F.lit(g) for g in groups]), group - 1))
    return F.when(group == 0, 0).otherwise((group - 1) * width + inside)


def beside_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): every row beside the next by descending doc_id (null
    last, equal ids by their text's hash), the last beside the first. Null texts count as empty.

    Ids are cut into ranges at approximate quantiles, at most RANGES of them, and each is ordered by
    itself; a range's last row looks up the first row of the next range, of which there is one a range.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")
    )
    n = max(1, min(RANGES, docs.count() // RANGE_ROWS))
    bounds = []
    if n > 1:
        ids = rows.select("doc_id")
        bounds = sorted({int(b) for b in ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})
    # Rows without an id come last, in 4,096 ranges of their text's hash.
    unnamed = (F.shiftright("text_key", 52) - 2048).cast("int")
    place = F.when(F.col("doc_id").isNull(), unnamed).otherwise(_range_of(F.col("doc_id"), bounds))
    rows = rows.withColumn("range", place)
    keys = rows.select("range", "doc_id", "text_key")
    firsts = keys.groupBy("range").agg(F.max(F.struct("doc_id", "text_key")).alias("first"))
    # One row a range, at most RANGES and 4,096 more.
    onward = Window.orderBy(F.desc("range"))
    whole = onward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("first").over(onward), F.first("first").over(whole))
    firsts = firsts.select(F.col("range").alias("before"), after.alias("after"))
    firsts = firsts.select("before", F.col("after.doc_id").alias("after_id"), F.col("after.text_key").alias("after_key"))
    at = rows["doc_id"].eqNullSafe(firsts["after_id"]) & (rows["text_key"] == firsts["after_key"])
    edges = rows.join(F.broadcast(firsts), at).groupBy("before").agg(F.max("text").alias("edge"))
    edges = with_signatures(edges.select(F.col("before").alias("range"), "edge"), "edge", "edge_sigs")
    signed = with_signatures(rows.repartition("range"), "text", "sigs")
    order = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), F.desc("text_key"))
    signed = signed.withColumns({"ahead": F.lead("text").over(order), "ahead_sigs": F.lead("sigs").over(order)})
    last = F.col("ahead").isNull()
    return signed.join(edges, "range").select(
        "doc_id",
        "text",
        "sigs",
        F.when(last, F.col("edge")).otherwise(F.col("ahead")).alias("next_text"),
        F.when(last, F.col("edge_sigs")).otherwise(F.col("ahead_sigs")).alias("next_sigs"),
    )


def edited_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every
    row. The edited text has the last third of the code points replaced by the first as many of the next
    document. Columns other than doc_id and text are not looked at."""
    rows = beside_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring("text", 1, (F.col("n_chars") - third).cast("int"))
    rows = rows.withColumn("edited", F.concat(kept, F.substring("next_text", 1, third)))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
