"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong spans are reported wherever they stand: assigned secrets, access identifiers, long hexadecimal runs.
Weak candidates - user names, short assigned secrets, bare keys, endpoints - are common in clean text. One is
reported only if a part that completes it to a credential stands in its scope, at most REACH code points away: a
secret beside an identifier or an endpoint, an identifier or an endpoint beside a secret. A scope is a block of a
text between blank lines. The parts are joined by document, scope and interval: each part's reach is cut into bins
of fixed width, so a join row is a part in a bin and a bin holds a bounded number of parts.

Offsets count code points, ends exclusive. A null text counts as empty. Rows alike in doc_id and text are scanned
as one document and each reported. Of extra columns nothing is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pactlake.llm.tables import row_key, text_key, written

#: A weak candidate and the part that completes it are at most so far apart, in code points.
REACH = 200
#: Width of the bins of the interval join.
BIN = 256


def either(words: str) -> str:
    """A pattern for words of letters, `_`, `?` and `|`, its letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_SET = r"""["']?\x20*[:=]\x20*["']?"""

#: What is looked for, leftmost and non-overlapping for each: kinds by pattern. The base kinds come first and in this
#: order, which is also the order of spans that start together.
ASSIGN = f"({either('password|passwd|secret|token|api_?key')}){_SET}([A-Za-z0-9+/_.=-]+)"
#: Equal to `AKIA[A-Z0-9]+` of 18 characters or more: a run in which the first such match is too short has no longer one.
ACCESS = r"AKIA[A-Z0-9]{14,}"
#: Equal to `[0-9a-f]+` of 16 characters or more.
HEX = r"[0-9a-f]{16,}"
USER = f"({either('access_?key_?id|client_?id|account_?id|user_?name|user|login')}){_SET}([A-Za-z0-9@+/_.-]+)"
KEY = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = (
    "(https?|wss?|ftps?|sftp|ssh|ldaps?|amqps?|rediss?|mongodb|mysql|postgres|postgresql|s3)"
    r"""://[^\x00-\x20"'<>\x7F]+"""
)
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "user": USER, "key": KEY, "endpoint": ENDPOINT}
#: A blank line ends a scope.
BLANK = r"\n[\x20\x09\x0D]*\n"

#: Characters of an assigned secret, of a short one, of a user's name, of a bare key.
ASSIGNED, SHORT, NAME, BARE = 12, 6, 3, 40

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "user", "short", "key", "endpoint")
SECRETS = ("assign", "hex", "short", "key")


def _pieces(text: Column, found: Column, pattern: str) -> Column:
    """(gap, found) for each match: the length of the text between it and the one before, and the match."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
    return F.arrays_zip(gaps.alias("gap"), found.alias("found"))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, and for each pattern an array of (gap, found)), a row for each document. Only blank
    lines of texts that may hold a complete credential are looked for, as `blank`."""
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), text)
    found = [F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(name) for name, p in PATTERNS.items()]
    rows = rows.select("*", *found)
    some = {name: F.size(name) > 0 for name in PATTERNS}
    complete = (some["assign"] | some["hex"] | some["key"]) & (some["access"] | some["user"] | some["endpoint"])
    rows = rows.withColumn("blank", F.when(complete, F.regexp_extract_all("text", F.lit(BLANK), F.lit(0))))
    cut = {**PATTERNS, "blank": BLANK}
    pieces = [F.when(F.size(n) > 0, _pieces(F.col("text"), F.col(n), p)).alias(n) for n, p in cut.items()]
    return rows.select("doc_id", "text_key", *pieces)


def parts(rows: DataFrame) -> DataFrame:
    """(doc, kind, start, end, scope) of every strong span and weak candidate; doc is the row's key."""
    names = [*PATTERNS, "blank"]
    each = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("pieces")) for n in names])
    rows = rows.where(F.coalesce(*names).isNotNull()).dropDuplicates(["doc_id", "text_key"])
    kinds = rows.select("doc_id", "text_key", F.explode(each).alias("of")).select("doc_id", "text_key", "of.*")
    found = kinds.select("doc_id", "text_key", "kind", F.posexplode("pieces").alias("nth", "of"))
    doc = ["doc_id", "text_key"]
    so_far = Window.partitionBy(*doc, "kind").orderBy("nth")
    end = F.sum(F.col("of.gap").cast("bigint") + F.length("of.found")).over(so_far)
    found = found.select(*doc, "kind", F.col("of.found").alias("found"), end.alias("end"))
    found = found.withColumn("start", F.col("end") - F.length("found"))
    value = {kind: F.length(F.regexp_extract("found", PATTERNS[kind], 2)) for kind in ("assign", "user")}
    bare = F.length("found") == BARE
    for letters in ("[A-Z]", "[a-z]", "[0-9]"):
        bare = bare & F.col("found").rlike(letters)
    kind = F.col("kind")
    kind = (
        F.when(kind == "assign", F.when(value["assign"] >= ASSIGNED, "assign").when(value["assign"] >= SHORT, "short"))
        .when(kind == "user", F.when(value["user"] >= NAME, kind))
        .when(kind == "key", F.when(bare, kind))
        .otherwise(kind)
    )
    found = found.select(*doc, kind.alias("kind"), "start", "end").where("kind is not null")
    before = Window.partitionBy(*doc).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("scope", F.count_if(F.col("kind") == "blank").over(before))
    return found.where("kind <> 'blank'").select(row_key(key="text_key").alias("doc"), "kind", "start", "end", "scope")


def _binned(found: DataFrame, reach: int) -> DataFrame:
    """Parts in each bin that their interval, longer by `reach` at both ends, touches."""
    low, high = F.expr(f"(start - {reach}) div {BIN}"), F.expr(f"(end + {reach} - 1) div {BIN}")
    low = F.when(F.col("start") < reach, F.lit(0)).otherwise(low)
    return found.withColumn("bin", F.explode(F.sequence(low, high)))


def linked(found: DataFrame) -> DataFrame:
    """(doc, kind, start, end) of the weak candidates that a part in their scope completes."""
    found = found.withColumn("secret", F.col("kind").isin(*SECRETS))
    weak = _binned(found.where(~F.col("kind").isin(*BASE)), 0)
    near = _binned(found, REACH).select(
        *[F.col(c).alias(f"{c}_near") for c in ("doc", "scope", "bin", "secret", "start", "end")]
    )
    meets = (F.col("doc") == F.col("doc_near")) & (F.col("scope") == F.col("scope_near")) & (F.col("bin") == F.col("bin_near"))
    meets = meets & (F.col("secret") != F.col("secret_near"))
    meets = meets & (F.col("start") <= F.col("end_near") + REACH) & (F.col("start_near") <= F.col("end") + REACH)
    return weak.join(near, meets, "left_semi").select("doc", "kind", "start", "end").distinct()


def spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): a row for each document; spans are structs (start, nth, kind, end) in the order of
    the report, nth being the kind's place among KINDS."""
    rows = written(spark, "secrets", scanned(docs))
    found = written(spark, "parts", parts(rows))
    shown = found.where(F.col("kind").isin(*BASE)).select("doc", "kind", "start", "end").union(linked(found))
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct("start", nth.alias("nth"), "kind", "end")
    of_docs = shown.groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    rows = rows.select("doc_id", "text_key", row_key(key="text_key").alias("doc"))
    return rows.join(of_docs, "doc", "left").drop("doc")


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): a row for each document; spans as text, kind:start:end
    joined by commas."""
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,nth:bigint,kind:string,end:bigint>>")
    found = spans(spark, docs).withColumn("spans", F.coalesce("spans", none))

    def told(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    base = F.filter("spans", lambda x: x.nth <= len(BASE))
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
