"""Payload conformance against whole schemas: references, combinations and nested members.

A schema document is compiled into nodes, one for each subschema, named by its JSON pointer, and edges between
them. A payload is then visited level by level: a visit is a value of the payload at a node, and the edges of a
node lead on to the same value (`allOf`, `$ref`, ...), its members or its items. Each visit has the violations of
its own assertions; they are folded back level by level, by grouped counts, as the keyword of the edge asks.
All levels are tables that Spark joins and groups by payload and visit; there are as many as the payload is
deep, with the references on the way. Equal payloads of a version are visited once. Where the documents are few, small
and not recursive, the same compiled nodes become expressions of the payload's row instead (`inlined`).

Violations are `code:place`, the place being a JSON pointer into the payload (`#` is its root). Below `anyOf`, `oneOf`,
`not`, `if`, `contains` and `propertyNames` only the keyword itself is reported.

Not judged, and reported as `unsupported_keyword:pointer into the schema` for every payload of that version: dynamic
and remote references, `unevaluated*`, unknown types, and patterns beyond plain regular expressions (classes, groups
two deep, quantifiers), as their dialects differ. A reference that leads back to itself on one value adds nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pactlake.functions.text import trimmed
from pactlake.operators import payloads as flat
from pactlake.operators.documents import flag_is_true
from pactlake.operators.inlined import Inlined, inline
from pactlake.session import shared_folder

# Keywords that hold schemas by name, in a list, or alone.
NAMED = ("properties", "patternProperties", "dependentSchemas", "$defs", "definitions")
LISTED = ("allOf", "anyOf", "oneOf", "prefixItems")
SINGLE = ("not", "if", "then", "else", "items", "contains", "additionalProperties", "propertyNames")
#: Keywords whose schemas look at the same value.
SAME = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref")
#: Keywords whose violations are the value's own.
JOINED = (
    "allOf", "$ref", "properties", "patternProperties", "additionalProperties", "items", "prefixItems", "dependentSchemas",
)
# Keywords that are not judged.
UNSUPPORTED = (
    "$dynamicRef", "$recursiveRef", "additionalItems", "dependencies", "unevaluatedItems", "unevaluatedProperties",
)

_TEXTS = "array<string>"
#: What every regular expression dialect reads alike; ranges go upwards, groups are up to two deep.
_ESCAPE = r"\\[dDwWsS.^$*+?()\[\]{}|/\\-]"
_CLASS = rf"\[\^?(?:a-z|A-Z|0-9|[^\\\[\]&^-]|{_ESCAPE})+-?\]"
_TIMES = r"(?:(?:[*+?]|\{[0-9]{1,4}(?:,[0-9]{0,4})?\})\??)?"
_PLAIN = rf"(?:[\^$]|(?:[^\\\[\](){{}}|*+?^$]|{_ESCAPE}|{_CLASS}){_TIMES})*"
_ALONE = rf"{_PLAIN}(?:\|{_PLAIN})*"
_INNER = rf"(?:{_PLAIN}|\((?:\?:)?{_ALONE}\){_TIMES}|\|)*"
PLAIN_PATTERN = rf"^(?:{_PLAIN}|\((?:\?:)?{_INNER}\){_TIMES}|\|)*\z"


def _get(body: Column, keyword: str, kind: str) -> Column:
    return F.try_variant_get(body, f"$['{keyword}']", kind)


def _texts() -> Column:
    return F.array().cast(_TEXTS)


def plain(pattern: Column) -> Column:
    """Whether a pattern can be handed to Spark: quantifiers like {3,2} cannot."""
    pairs = F.regexp_extract_all(pattern, F.lit(r"(\{[0-9]+,[0-9]+\})"), F.lit(1))
    low = lambda p: F.regexp_extract(p, r"([0-9]+),", 1).cast("int")
    high = lambda p: F.regexp_extract(p, r",([0-9]+)", 1).cast("int")
    return pattern.rlike(PLAIN_PATTERN) & ~F.exists(pairs, lambda p: low(p) > high(p))


def _children(body: Column) -> Column:
    """The schemas right below a schema: (kind, arg, ord, body)."""

    def child(kind: str, arg: Column, ord_: Column, of: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), arg.cast("string").alias("arg"), ord_.cast("int").alias("ord"), of.alias("body"))

    none, zero = F.lit(None), F.lit(0)
    found = []
    for name in NAMED:
        entries = F.map_entries(_get(body, name, "map<string,variant>"))
        found.append(_named(entries, name, child))
    for name in LISTED:
        found.append(_numbered(_get(body, name, "array<variant>"), name, child))
    # An array of schemas under `items` is the older way to write `prefixItems`.
    found.append(_numbered(_get(body, "items", "array<variant>"), "prefixItems", child))
    for name in SINGLE:
        value = _get(body, name, "variant")
        there = value.isNotNull() & (F.lit(True) if name != "items" else flat.kind(value) != "ARRAY")
        found.append(F.when(there, F.array(child(name, none, zero, value))))
    empty = F.array().cast("array<struct<kind:string,arg:string,ord:int,body:variant>>")
    return F.concat(*[F.coalesce(x, empty) for x in found])


def _named(entries: Column, name: str, child) -> Column:
    return F.transform(entries, lambda e: child(name, e["key"], F.lit(0), e["value"]))


def _numbered(values: Column, name: str, child) -> Column:
    return F.transform(values, lambda v, i: child(name, F.lit(None), i, v))


def _info(body: Column) -> Column:
    """What a node asserts of a value by itself."""
    enum, const = _get(body, "enum", "array<variant>"), _get(body, "const", "variant")
    pattern = _get(body, "pattern", "string")
    return F.struct(
        (_as_flag(body) == F.lit(False)).alias("never"),
        flat._type_names(body).alias("types"),
        F.coalesce(flag_is_true(F.try_variant_get(body, "$.nullable", "string")), F.lit(False)).alias("nullable"),
        flat._canonical_all(enum).alias("allowed"),
        F.get(flat._canonical_all(F.when(const.isNotNull(), F.array(const))), F.lit(0)).alias("const"),
        flat._bounds(body).alias("bounds"),
        F.coalesce(_get(body, "required", _TEXTS), _texts()).alias("required"),
        F.map_entries(_get(body, "dependentRequired", f"map<string,{_TEXTS}>")).alias("dependent"),
        F.when(plain(pattern), pattern).alias("pattern"),
        _get(body, "contains", "variant").isNotNull().alias("contains"),
        F.coalesce(_get(body, "minContains", "bigint"), F.lit(1)).alias("min_contains"),
        _get(body, "maxContains", "bigint").alias("max_contains"),
    )


def _as_flag(body: Column) -> Column:
    """true or false where a schema is just that."""
    return F.coalesce(F.when(flat.kind(body) == "BOOLEAN", body.try_cast("boolean")), F.lit(True))


def _stored(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    path = shared_folder(spark, name)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _pointer(parent: Column, child: Column) -> Column:
    name = F.replace(F.replace(child["arg"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    step = F.when(child["arg"].isNotNull(), name).when(child["kind"].isin(*LISTED), child["ord"].cast("string"))
    return F.concat_ws("/", parent, child["kind"], step)


class Compiled(NamedTuple):
    """Schemas as tables: roots, (contract_id, version, info) of each document that is JSON; edges, (contract_id, version,
    node, kind, arg, ord, names, patterns, skip, child, info) with the child's assertions; odd, (contract_id, version,
    codes) of what is not judged; and, where they are few, small and not recursive, as expressions."""

    roots: DataFrame
    edges: DataFrame
    odd: DataFrame
    inlined: Inlined | None


def compile_schemas(spark: SparkSession, docs: DataFrame) -> Compiled:
    """docs: one document for each contract and version."""
    of = ["contract_id", "version"]
    tree = docs.select(*of, F.lit("#").alias("node"), F.try_parse_json("schema_json").alias("body")).where("body is not null")
    level, nodes, edges = _stored(spark, "schema-nodes", tree), None, None
    while not level.isEmpty():
        nodes = level if nodes is None else nodes.union(level)
        body = F.col("body")
        # What members and items the named and numbered schemas leave to the others.
        names = F.coalesce(F.map_keys(_get(body, "properties", "map<string,variant>")), _texts())
        patterns = F.coalesce(F.map_keys(_get(body, "patternProperties", "map<string,variant>")), _texts())
        skip = F.coalesce(F.size(_get(body, "prefixItems", "array<variant>")), F.lit(0))
        below = level.select(
            *of, F.col("node").alias("parent"), names.alias("names"), patterns.alias("patterns"), skip.alias("skip"),
            F.explode(_children(body)).alias("c"),
        )
        below = below.select(
            *of, "parent", "names", "patterns", "skip", F.col("c.kind").alias("kind"), F.col("c.arg").alias("arg"),
            F.col("c.ord").alias("ord"), _pointer(F.col("parent"), F.col("c")).alias("node"), F.col("c.body").alias("body"),
        )
        below = _stored(spark, "schema-nodes", below)
        step = below.where(~F.col("kind").isin("$defs", "definitions")).drop("body")
        edges = step if edges is None else edges.union(step)
        level = below.select(*of, "node", "body")
    if nodes is None:
        nodes, edges = level, level.select(
            *of, F.col("node").alias("parent"), _texts().alias("names"), _texts().alias("patterns"), F.lit(0).alias("skip"),
            F.lit("").alias("kind"), F.lit("").alias("arg"), F.lit(0).alias("ord"), "node",
        )
    refs = nodes.select(*of, F.col("node").alias("parent"), _get(F.col("body"), "$ref", "string").alias("node"))
    refs = refs.where("node is not null").select(
        *of, "parent", _texts().alias("names"), _texts().alias("patterns"), F.lit(0).alias("skip"), F.lit("$ref").alias("kind"),
        F.lit(None).cast("string").alias("arg"), F.lit(0).alias("ord"), "node",
    )
    info = nodes.select(*of, "node", _info(F.col("body")).alias("info"))
    edges = edges.union(refs).join(info, [*of, "node"], "left")
    edges = _stored(spark, "schema-edges", edges.withColumnsRenamed({"node": "child", "parent": "node"}))
    body = F.col("body")
    strange = F.array_intersect(F.map_keys(body.try_cast("map<string,variant>")), F.array(*map(F.lit, UNSUPPORTED)))
    types = F.exists(flat._type_names(body), lambda t: ~t.isin(*flat.TYPE_NAMES))
    pattern = _get(body, "pattern", "string")
    keys = F.map_keys(_get(body, "patternProperties", "map<string,variant>"))
    said = F.concat(
        F.coalesce(strange, _texts()),
        F.when(types, F.array(F.lit("type"))).otherwise(_texts()),
        F.when(pattern.isNotNull() & ~plain(pattern), F.array(F.lit("pattern"))).otherwise(_texts()),
        F.when(F.exists(keys, lambda k: ~plain(k)), F.array(F.lit("patternProperties"))).otherwise(_texts()),
    )
    odd = nodes.select(*of, "node", F.explode(said).alias("keyword"))
    lost = edges.where("info is null").select(*of, "node", F.lit("$ref").alias("keyword"))
    odd = odd.union(lost).groupBy(*of).agg(
        F.collect_set(F.concat(F.lit("unsupported_keyword:"), "node", F.lit("/"), "keyword")).alias("codes")
    )
    roots = info.where("node = '#'").drop("node")
    edges, usual = edges.where("info is not null"), lambda p: F.coalesce(plain(p), F.lit(False))
    marked = edges.withColumns({"usual": usual(F.col("arg")), "rests": F.filter("patterns", usual)})
    return Compiled(roots, edges, odd, inline(docs, roots, marked, odd))


def _own(value: Column, k: Column, info: Column, path: Column, via: Column) -> Column:
    """Violations of a node's own assertions."""
    described = F.struct(
        F.struct(
            path.alias("name"), info["types"].alias("types"), info["allowed"].alias("allowed"), info["const"].alias("const"),
            F.lit(None).cast(_TEXTS).alias("item_types"), info["bounds"].alias("bounds"),
        ).alias("f"),
        value.alias("v"),
        k.alias("k"),
    )
    names = F.when(k == "OBJECT", F.map_keys(value.try_cast("map<string,variant>")))
    missing = F.transform(F.array_except(info["required"], names), lambda n: F.concat(F.lit("required:"), path, F.lit("/"), n))
    wanted = F.flatten(
        F.transform(F.filter(info["dependent"], lambda d: F.array_contains(names, d["key"])), lambda d: F.array_except(d["value"], names))
    )
    dependent = F.transform(wanted, lambda n: F.concat(F.lit("dependentRequired:"), path, F.lit("/"), n))
    text = F.when(k == "STRING", value.try_cast("string"))
    unlike = info["pattern"].isNotNull() & ~F.coalesce(F.regexp_like(text, info["pattern"]), F.lit(True))
    own = F.concat(
        flat._member_violations(described),
        F.coalesce(missing, _texts()),
        F.coalesce(dependent, _texts()),
        F.when(unlike, F.array(F.concat(F.lit("pattern:"), path))).otherwise(_texts()),
    )
    nothing = info["nullable"] & (k == "VOID")
    return F.when(info["never"], F.array(F.concat(via, F.lit(":"), path))).when(nothing, _texts()).otherwise(own)


def _visits(rows: DataFrame) -> DataFrame:
    """Visits with their kind, violations and what the fold needs, in place of the node's whole description."""
    rows = rows.withColumn("k", flat.kind(F.col("value")))
    info, k = F.col("info"), F.col("k")
    return rows.select(
        "key", "contract_id", "version", "node", "visit", "parent", "via", "path", "value", "k", "seen",
        _own(F.col("value"), k, info, F.col("path"), F.col("via")).alias("own"),
        # A null that is allowed, or a schema that is just false, asks no more.
        (info["never"] | (info["nullable"] & (k == "VOID"))).alias("ended"),
        F.when(k == "ARRAY", info["contains"]).alias("contains"),
        info["min_contains"].alias("min_contains"), info["max_contains"].alias("max_contains"),
    )


def _targets() -> Column:
    """Where an edge leads from a value: (step, value), step being null for the value itself."""
    kind, arg, value, k = (F.col(c) for c in ("kind", "arg", "value", "k"))
    members = F.when(k == "OBJECT", value.try_cast("map<string,variant>"))
    entries, items = F.map_entries(members), F.when(k == "ARRAY", value.try_cast("array<variant>"))

    def to(step: Column, of: Column) -> Column:
        return F.struct(step.cast("string").alias("step"), of.alias("value"))

    def like_any(name: Column) -> Column:
        return F.exists("patterns", lambda p: plain(p) & F.regexp_like(name, F.when(plain(p), p)))

    numbered = F.transform(items, lambda v, i: to(i, v))
    itself = F.array(to(F.lit(None), value))
    named = lambda e: to(e["key"], e["value"])
    rest = F.filter(entries, lambda e: ~F.array_contains(F.col("names"), e["key"]) & ~like_any(e["key"]))
    like = F.filter(entries, lambda e: F.regexp_like(e["key"], F.when(plain(arg), arg)))
    has = F.array_contains(F.map_keys(members), arg)
    return (
        F.when(kind.isin(*SAME) | ((kind == "dependentSchemas") & has), itself)
        .when(kind == "properties", F.transform(F.filter(entries, lambda e: e["key"] == arg), named))
        .when(kind == "patternProperties", F.transform(like, named))
        .when(kind == "additionalProperties", F.transform(rest, named))
        .when(kind == "propertyNames", F.transform(F.map_keys(members), lambda n: to(n, n.cast("variant"))))
        .when(kind == "prefixItems", F.filter(numbered, lambda t: t["step"] == F.col("ord").cast("string")))
        .when(kind == "items", F.filter(numbered, lambda t: t["step"].cast("int") >= F.col("skip")))
        .when(kind == "contains", numbered)
    )


def _below(level: DataFrame, edges: DataFrame) -> DataFrame:
    """The visits that the edges of a level's nodes lead to."""
    met = level.where(~F.col("ended")).select("key", "contract_id", "version", "node", "visit", "path", "value", "k", "seen")
    met = met.join(edges, ["contract_id", "version", "node"])
    met = met.withColumn("to", F.explode(_targets()))
    same = F.col("to.step").isNull()
    step = F.replace(F.replace(F.col("to.step"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    met = met.where(~(same & F.array_contains("seen", F.col("child"))))
    return _visits(
        met.select(
            "key", "contract_id", "version", F.col("child").alias("node"),
            F.xxhash64("visit", "node", "kind", "child", "to.step").alias("visit"), F.col("visit").alias("parent"), F.col("kind").alias("via"),
            F.when(same, F.col("path")).otherwise(F.concat("path", F.lit("/"), step)).alias("path"), F.col("to.value").alias("value"),
            F.when(same, F.array_append("seen", F.col("child"))).otherwise(F.array("child")).alias("seen"), "info",
        )
    )


def _folded(level: DataFrame, below: DataFrame) -> DataFrame:
    """(key, visit, parent, via, errors): the violations of a level's visits with those that the visits below them
    bring, each as its keyword asks."""
    via, ok = F.col("via"), F.size("errors") == 0

    def errors_of(*kinds: str) -> Column:
        return F.flatten(F.collect_list(F.when(via.isin(*kinds), F.col("errors"))))

    grouped = below.groupBy("key", "parent").agg(
        errors_of(*JOINED).alias("joined"),
        errors_of("then").alias("then"),
        errors_of("else").alias("else"),
        *[F.count_if(via == k).alias(f"{k}_n") for k in ("anyOf", "oneOf", "if")],
        *[F.count_if((via == k) & ok).alias(f"{k}_ok") for k in ("anyOf", "oneOf", "not", "if", "contains")],
        F.count_if((via == "propertyNames") & ~ok).alias("names_bad"),
    )
    level = level.select("key", "visit", F.col("parent").alias("of"), "via", "path", "own", "contains", "min_contains", "max_contains")
    met = level.join(grouped, (level["key"] == grouped["key"]) & (level["visit"] == grouped["parent"]), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))

    def code(keyword: str, broken: Column) -> Column:
        return F.when(broken, F.array(F.concat(F.lit(f"{keyword}:"), F.col("path")))).otherwise(_texts())

    contains = F.col("contains") & (
        (number("contains_ok") < F.col("min_contains")) | F.coalesce(number("contains_ok") > F.col("max_contains"), F.lit(False))
    )
    branch = F.when(number("if_n") == 0, _texts()).when(number("if_ok") > 0, F.col("then")).otherwise(F.col("else"))
    errors = F.concat(
        "own",
        F.coalesce("joined", _texts()),
        code("anyOf", (number("anyOf_n") > 0) & (number("anyOf_ok") == 0)),
        code("oneOf", (number("oneOf_n") > 0) & (number("oneOf_ok") != 1)),
        code("not", number("not_ok") > 0),
        F.coalesce(branch, _texts()),
        code("contains", contains),
        code("propertyNames", number("names_bad") > 0),
    )
    return met.select(level["key"], level["visit"], F.col("of").alias("parent"), "via", F.array_distinct(errors).alias("errors"))


def check_whole(spark: SparkSession, payloads: DataFrame, docs: DataFrame, compiled: Compiled | None = None) -> DataFrame:
    """Payload rows, all their columns, plus `valid` and sorted `violations`. docs: one document for each contract and
    version; compiled: its compile_schemas, where that is at hand. An unknown contract, a null or malformed payload
    gives the same codes as in the flat check."""
    roots, edges, odd, inlined = compiled or compile_schemas(spark, docs)
    known = docs.select("contract_id", "version").join(odd, ["contract_id", "version"], "left")
    keyed = payloads.select(
        F.struct("*").alias("row"),
        trimmed("contract_id").alias("contract_id"),
        trimmed(F.regexp_replace("version", r"\.json\z", "")).alias("version"),
        "payload",
    )
    kept = [F.col("row")[c].alias(c) for c in payloads.columns if c not in ("valid", "violations")]
    if inlined:
        # One large file or a hot contract is judged by every core.
        spread = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return inlined.check(spread).select(*kept, (F.size("violations") == 0).alias("valid"), "violations")
    # 128 bits name a payload of a version.
    text = ["contract_id", "version", "payload"]
    keyed = keyed.withColumn("key", F.struct(F.xxhash64(*text).alias("a"), F.xxhash64(F.lit(1), *text).alias("b")))
    once = keyed.where("payload is not null").groupBy("key", "contract_id", "version").agg(F.min("payload").alias("payload"))
    root = once.withColumn("value", F.try_parse_json("payload")).where("value is not null").join(roots, ["contract_id", "version"])
    level = _visits(
        root.select(
            "key", "contract_id", "version", F.lit("#").alias("node"), F.xxhash64("key").alias("visit"),
            F.lit(None).cast("bigint").alias("parent"), F.lit("false").alias("via"), F.lit("#").alias("path"), "value",
            F.array(F.lit("#")).alias("seen"), "info",
        )
    )
    levels = [_stored(spark, "payload-visits", level)]
    while True:
        below = _stored(spark, "payload-visits", _below(levels[-1], edges))
        if below.isEmpty():
            break
        levels.append(below)
    found = levels[-1].select("key", "visit", "parent", "via", F.array_distinct("own").alias("errors"))
    found = _folded(levels[-1], found.where(F.lit(False)))
    for n in range(len(levels) - 2, -1, -1):
        found = _folded(levels[n], found)
        # Cuts the plan of deep payloads.
        found = _stored(spark, "payload-folds", found) if n and n % 4 == 0 else found
    found = found.select("key", "errors")
    joined = keyed.join(known.withColumn("known", F.lit(True)), ["contract_id", "version"], "left").join(found, "key", "left")
    one = lambda code: F.array(F.lit(code))
    violations = (
        F.when(F.col("payload").isNull(), one(flat.PAYLOAD_NULL))
        .when(F.col("known").isNull(), one(flat.CONTRACT_UNKNOWN))
        .when(F.col("errors").isNull(), one(flat.PAYLOAD_MALFORMED))
        .otherwise(F.sort_array(F.array_distinct(F.concat("errors", F.coalesce("codes", _texts())))))
    )
    return joined.select(*kept, (F.size(violations) == 0).alias("valid"), violations.alias("violations"))
