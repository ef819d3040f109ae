"""Contract tables derived from the given parquet tables, all by Spark.

Nothing here is sampled or cut: every derived table grows with its source tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pactlake.functions.versions import version_of
from pactlake.operators.ordering import number_within
from pactlake.operators.policy import PolicyPacks

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
POLICY_TEXT = """{
  "defaultPack": "baseline",
  "packs": {
    "strict": {"rules": {"enum-value-added": "BREAKING"}},
    "relaxed": {"rules": {" ENUM_VALUE_ADDED ": "IGNORE", "FIELD_REMOVED": "BREAKING"}},
    "empty": {},
    "nullsev": {"rules": {"enum-value-added": null}}
  }
}"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick(key: Column, *values: str | None) -> Column:
    """The value at position key % len(values)."""
    chosen = None
    for i, value in enumerate(values):
        condition = key % len(values) == i
        lit = F.lit(value).cast("string")
        chosen = F.when(condition, lit) if chosen is None else chosen.when(condition, lit)
    return chosen


def contract_of(key: str | Column) -> Column:
    return F.concat(F.lit("cust."), F.col(key) if isinstance(key, str) else key)


def numbered_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with `ver`: their place among the customer's orders in time."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c"), "o_orderstatus", "o_orderdate"
    )
    day = F.col("o_orderdate").cast("date")
    return number_within(orders, "c", day, ["o_orderdate", "o_orderkey"], "ver")


def line_parts(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Order lines with the brand of their part as a field name."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_partkey", *columns)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .drop("l_partkey", "p_partkey")
    )


def field_name(brand: str = "p_brand") -> Column:
    return F.lower(F.regexp_replace(brand, "#", "_"))


def first_brands(spark: SparkSession, sf: str, orders: DataFrame) -> DataFrame:
    """Each brand of a customer with `fv`, the version of its first order."""
    # The lines meet their orders as they are: few of an order share a brand, and a huge order is split in the join.
    return (
        line_parts(spark, sf)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c", "p_brand")
        .agg(F.min("ver").alias("fv"))
        .withColumn("n", F.regexp_replace("p_brand", "^Brand#", "").cast("int"))
    )


def evolving_spec(c: Column, ver: Column, n: Column, fv: Column) -> dict[str, Column]:
    kind = F.when((c % 13 == 0) & (ver % 6 == 0) & (n % 5 == 1), "boolean").otherwise(
        pick(n, "string", "number", "integer")
    )
    age = F.least(F.floor((ver - fv) / 3), F.lit(3)).cast("int")
    enum = F.when(
        n % 2 == 0, F.transform(F.sequence(F.lit(1), 1 + age), lambda i: F.concat(F.lit("E"), i))
    ).otherwise(F.array().cast("array<string>"))
    return {
        "type": kind,
        "required": (c % 7 == 0) & (ver == fv),
        "nullable": n % 4 == 0,
        "enum_values": enum,
    }


def is_there(c: Column, ver: Column, n: Column, fv: Column) -> Column:
    return (ver >= fv) & ~((c % 11 == 0) & (ver % 4 == 0) & (n % 5 == 0))


def evolving_fields(spark: SparkSession, sf: str) -> DataFrame:
    """schema_fields of slowly growing contracts: a field appears with its brand's first order."""
    orders = numbered_orders(spark, sf).select("o_orderkey", "c", "ver")
    keys = [F.col(k) for k in ("c", "ver", "n", "fv")]
    rows = orders.select("c", "ver").join(first_brands(spark, sf, orders), "c").filter(is_there(*keys))
    return rows.select(
        contract_of("c").alias("contract_id"),
        version_of(F.col("ver")).alias("version"),
        F.col("ver").alias("version_num"),
        field_name().alias("field_name"),
        *[spec.alias(name) for name, spec in evolving_spec(*keys).items()],
    )


def evolving_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The evolving fields as a document for every order, also where it has no field.

    A customer's brands meet the orders as one list, so no row per field is made and grouped again.
    """
    orders = numbered_orders(spark, sf).select("o_orderkey", "c", "ver")
    brand = F.struct(field_name().alias("name"), "n", "fv")
    # A group is one customer's brands, of which there are as many as brands.
    brands = first_brands(spark, sf, orders).groupBy("c").agg(
        F.sort_array(F.collect_list(brand)).alias("brands")
    )
    c, ver = F.col("c"), F.col("ver")
    there = F.filter("brands", lambda b: is_there(c, ver, b["n"], b["fv"]))

    def member(b: Column) -> Column:
        spec = evolving_spec(c, ver, b["n"], b["fv"])
        body = body_text(spec["type"], spec["nullable"], spec["enum_values"], ver)
        return F.struct(b["name"].alias("name"), body.alias("body"), spec["required"].alias("needed"))

    return orders.join(brands, "c", "left").select(
        contract_of("c").alias("contract_id"),
        version_of(ver).alias("version"),
        ver.alias("version_num"),
        F.coalesce(F.transform(there, member), F.array().cast(MEMBERS)).alias("members"),
    ).transform(rendered)


def fields_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_parts(
        spark, sf, "l_returnflag", "l_linestatus", "l_discount", "l_linenumber"
    )
    return lines.groupBy("l_orderkey", "p_brand").agg(
        F.min("l_returnflag").alias("flag"),
        F.max(F.col("l_linestatus") == "F").alias("required"),
        F.max(F.col("l_discount") > 0.05).alias("nullable"),
        F.sort_array(F.collect_set(F.concat(F.lit("E"), "l_linenumber"))).alias("seen"),
    )


def churning_type(flag: Column) -> Column:
    return F.when(flag == "A", "string").when(flag == "N", "number").otherwise("integer")


def churning_enum(ver: Column, brand: Column, seen: Column) -> Column:
    return F.when((ver + F.length(brand)) % 4 == 0, F.array().cast("array<string>")).otherwise(seen)


def churning_fields(spark: SparkSession, sf: str) -> DataFrame:
    """schema_fields where each order is a version of its own: every kind of change occurs."""
    orders = numbered_orders(spark, sf).select("o_orderkey", "c", "ver")
    rows = fields_of_orders(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        contract_of("c").alias("contract_id"),
        version_of(F.col("ver")).alias("version"),
        F.col("ver").alias("version_num"),
        field_name().alias("field_name"),
        churning_type(F.col("flag")).alias("type"),
        "required",
        "nullable",
        churning_enum(F.col("ver"), F.col("p_brand"), F.col("seen")).alias("enum_values"),
    )


def churning_documents(spark: SparkSession, sf: str, how: str = "left") -> DataFrame:
    """The churning fields as a document for every order, also where it has no field (with an inner join
    only where it has one); an order's fields are gathered before they meet it."""
    orders = numbered_orders(spark, sf).select("o_orderkey", "c", "ver")
    field = F.struct(field_name().alias("name"), "p_brand", "flag", "required", "nullable", "seen")
    gathered = fields_of_orders(spark, sf).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(field)).alias("fields")
    )
    ver = F.col("ver")

    def member(f: Column) -> Column:
        enum = churning_enum(ver, f["p_brand"], f["seen"])
        body = body_text(churning_type(f["flag"]), f["nullable"], enum, ver)
        return F.struct(f["name"].alias("name"), body.alias("body"), f["required"].alias("needed"))

    rows = orders.join(gathered, F.col("l_orderkey") == F.col("o_orderkey"), how)
    return rows.select(
        contract_of("c").alias("contract_id"),
        version_of(ver).alias("version"),
        ver.alias("version_num"),
        F.coalesce(F.transform("fields", member), F.array().cast(MEMBERS)).alias("members"),
    ).transform(rendered)


MEMBERS = "array<struct<name:string,body:string,needed:boolean>>"


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def body_text(kind: Column, nullable: Column, enum: Column, ver: Column) -> Column:
    """A property as JSON. Nullability is written as a type union in even versions and as a flag in
    odd ones."""
    even = ver % 2 == 0
    return F.concat(
        F.lit('{"type":'),
        F.when(nullable & even, F.concat(F.lit("["), _quoted(kind), F.lit(',"null"]'))).otherwise(
            _quoted(kind)
        ),
        F.when(nullable & ~even, F.lit(',"nullable":true')).otherwise(""),
        F.when(
            F.size(enum) > 0,
            F.concat(F.lit(',"enum":["'), F.array_join(enum, '","'), F.lit('"]')),
        ).otherwise(""),
        F.lit("}"),
    )


def rendered(docs: DataFrame) -> DataFrame:
    """Replace `members`, ordered by name, by the document's text."""
    properties = F.array_join(
        F.transform("members", lambda m: F.concat(_quoted(m["name"]), F.lit(":"), m["body"])), ","
    )
    needed = F.array_join(
        F.transform(F.filter("members", lambda m: m["needed"]), lambda m: _quoted(m["name"])), ","
    )
    return docs.select(
        "contract_id",
        "version",
        "version_num",
        F.concat(
            F.lit('{"type":"object","properties":{'),
            properties,
            F.lit('},"required":['),
            needed,
            F.lit("]}"),
        ).alias("schema_json"),
    )


def schema_docs(fields: DataFrame) -> DataFrame:
    """Fields rendered as JSON documents, one per version."""
    body = body_text(F.col("type"), F.col("nullable"), F.col("enum_values"), F.col("version_num"))
    members = fields.select(
        "contract_id",
        "version",
        "version_num",
        F.struct(
            F.col("field_name").alias("name"), body.alias("body"), F.col("required").alias("needed")
        ).alias("member"),
    )
    # One document holds one version's fields: a group is a single document, never more.
    grouped = members.groupBy("contract_id", "version", "version_num").agg(
        F.sort_array(F.collect_list("member")).alias("members")
    )
    return rendered(grouped)


EMPTY_DOCUMENT = '{"type":"object","properties":{},"required":[]}'


def all_documents(spark: SparkSession, sf: str, fields: DataFrame) -> DataFrame:
    """A document for every order, also where it has no field."""
    orders = numbered_orders(spark, sf)
    versions = orders.select(
        contract_of("c").alias("contract_id"),
        version_of(F.col("ver")).alias("version"),
        F.col("ver").alias("version_num"),
    )
    docs = schema_docs(fields).select("contract_id", "version", "schema_json")
    return versions.join(docs, ["contract_id", "version"], "left").withColumn(
        "schema_json", F.coalesce("schema_json", F.lit(EMPTY_DOCUMENT))
    )


# Faulty first documents by customer key % 50.
FAULTY_DOCS = {
    1: "{invalid-json}",
    2: "[]",
    3: '{"properties":{"a":{"type":"string"}},"required":["a","Ghost"]}',
    4: '{"properties":{"a":{}}}',
    5: '{"properties":{"a":{"type":"string","enum":"x"}}}',
    6: '{"properties":{"a":{"type":"string"}},"required":"a"}',
    11: '{"properties":{"a":{"type":"string","enum":["x",{"y":1}]}}}',
    12: '{"properties":[]}',
    13: '{"properties":{"a":{"type":5}}}',
    14: '{"properties":{"a":{"type":"string"}},"required":["a",1]}',
    15: '{"properties":{"a":{"type":" Unknown "}}}',
    17: '{"properties":{"a":5}}',
    18: '{"properties":{"a":{"type":["string",5]}}}',
    21: '{"properties":{"a":{"type":"number","type":"string"}},"required":["a"]}',
}


def customer_key(contract: str = "contract_id") -> Column:
    return F.regexp_extract(contract, "([0-9]+)$", 1).cast("long")


def faulty_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The churning documents with faults put into first versions."""
    docs = churning_documents(spark, sf, "inner").withColumn("fault", customer_key() % 50)
    beyond = docs.filter("fault = 23 and version_num = 1").withColumns(
        {
            "version": F.lit("v3000000000"),
            "version_num": F.lit(None).cast("int"),
            "schema_json": F.lit(EMPTY_DOCUMENT),
        }
    )
    docs = docs.unionByName(beyond)
    text = reduce(
        lambda found, item: found.when(F.col("fault") == item[0], F.lit(item[1])),
        list(FAULTY_DOCS.items())[1:],
        F.when(F.col("fault") == 1, F.lit(FAULTY_DOCS[1])),
    )
    return docs.filter("fault <> 16").select(
        _odd_id().alias("contract_id"),
        "version",
        "version_num",
        F.when(F.col("version_num") == 1, F.coalesce(text, "schema_json"))
        .otherwise(F.col("schema_json"))
        .alias("schema_json"),
    )


def _odd_id() -> Column:
    return F.when(F.col("fault") == 10, F.concat(F.lit("Cust-"), customer_key())).otherwise(
        F.col("contract_id")
    )


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    c = F.col("c_custkey")
    names = F.transform(
        F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("svc-"), i.cast("string"))
    )
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        contract_of("c_custkey").alias("contract_id"),
        F.lower("c_mktsegment").alias("owner_team"),
        F.lower("n_name").alias("domain"),
        pick(c, "BACKWARD", "FORWARD", "FULL").alias("compatibility_mode"),
        pick(c, None, "strict", "relaxed", "BASELINE ", "nope").alias("policy_pack"),
        F.slice(names, F.lit(1), (c % 4).cast("int")).alias("consumers"),
        F.lit("ACTIVE").alias("status"),
    )


KEYWORD_DOCUMENT = """{"type":"object","properties":{
  "n":{"type":"integer","minimum":10,"exclusiveMaximum":5000,"multipleOf":3},
  "v":{"exclusiveMinimum":20,"maximum":150.5},
  "s":{"type":"string","minLength":5,"maxLength":6},
  "a":{"type":"array","minItems":2,"maxItems":3,"uniqueItems":true,"items":{"type":["integer","null"]}},
  "c":{"const":1.0},
  "o":{"type":"object","minProperties":1,"maxProperties":1}},
  "additionalProperties":false,"minProperties":5,"maxProperties":6,"dependentRequired":{"s":["n"]}}"""


def keyword_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A payload per event that meets or breaks each keyword of KEYWORD_DOCUMENT."""
    i = F.col("event_id")
    parts = [
        F.when(i % 7 != 0, F.concat(F.lit('"n":'), i)),
        F.concat(F.lit('"v":'), F.col("value").cast("string")),
        F.concat(F.lit('"s":"'), "event_type", F.lit('"')),
        F.concat(
            F.lit('"a":['),
            F.concat_ws(
                ",",
                (i % 3).cast("string"),
                F.when(i % 5 != 0, (i % 4).cast("string")),
                F.when(i % 6 == 0, '"q"'),
                F.when(i % 11 == 0, "7,8"),
            ),
            F.lit("]"),
        ),
        F.concat(F.lit('"c":'), i % 2),
        F.concat(F.lit('"o":'), F.when(i % 13 == 0, "{}").when(i % 17 == 0, '{"p":1,"q":2}').otherwise('{"p":1}')),
        F.when(i % 19 == 0, '"x":0'),
    ]
    return table(spark, sf, "events").select(
        F.lit("kw.all").alias("contract_id"),
        F.lit("v1").alias("version"),
        i.cast("string").alias("payload_id"),
        F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("payload"),
    )


NESTED_DOCUMENT = """{"type":"object","required":["id","event"],
  "$defs":{"amount":{"anyOf":[{"type":"number","minimum":50},{"$ref":"#/$defs/code"}]},
    "code":{"type":"string","pattern":"^[A-Z]{2}-[0-9]+$"}},
  "properties":{"id":{"type":"integer"},
    "event":{"type":"object","required":["kind"],"additionalProperties":false,"properties":{
      "kind":{"enum":["click","error","purchase","signup","view"]},
      "props":{"type":"object","properties":{"k":{"type":"integer","maximum":90}}}}},
    "amount":{"$ref":"#/$defs/amount"},
    "codes":{"type":"array","items":{"$ref":"#/$defs/code"},"contains":{"const":"AA-1"}},
    "pair":{"prefixItems":[{"type":"integer"},{"type":"string"}],"items":false}},
  "if":{"properties":{"event":{"properties":{"kind":{"const":"error"}}}}},
  "then":{"required":["codes"]},"else":{"not":{"required":["trace"]}},
  "oneOf":[{"required":["a"]},{"required":["b"]}]}"""


def nested_payloads(events: DataFrame) -> DataFrame:
    """A payload per event that meets or breaks each part of NESTED_DOCUMENT; a pure projection."""
    i = F.col("event_id")
    kind = F.when(i % 11 == 0, "zzz").otherwise(F.col("event_type"))
    extra = F.when(i % 13 == 0, ',"e":1').otherwise("")
    amount = F.when(i % 5 == 0, F.concat(F.lit('"AB-'), i, F.lit('"'))).when(i % 5 == 1, '"ab"')
    codes = F.concat(
        F.when(i % 4 == 0, '"AA-2"').otherwise('"AA-1"'), F.lit(',"BB-'), i, F.lit('"'), F.when(i % 19 == 0, ',"bad"').otherwise("")
    )
    pair = F.concat(F.when(i % 29 == 0, '"s"').otherwise(i.cast("string")), F.lit(',"s"'), F.when(i % 23 == 0, ",1").otherwise(""))
    parts = [
        F.concat(F.lit('"id":'), F.when(i % 7 == 0, '"x"').otherwise(i.cast("string"))),
        F.when(i % 17 != 0, F.concat(F.lit('"event":{"kind":"'), kind, F.lit('","props":'), "props", extra, F.lit("}"))),
        F.concat(F.lit('"amount":'), F.coalesce(amount, F.col("value").cast("string"))),
        F.when(i % 3 != 0, F.concat(F.lit('"codes":['), codes, F.lit("]"))),
        F.concat(F.lit('"pair":['), pair, F.lit("]")),
        F.when(i % 31 == 0, '"trace":1'),
        F.when(i % 2 == 0, '"a":1'),
        F.when(i % 3 == 0, '"b":1'),
    ]
    return events.select(
        F.lit("nested.all").alias("contract_id"),
        F.lit("v1").alias("version"),
        i.cast("string").alias("payload_id"),
        F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("payload"),
    )


def nested_docs(spark: SparkSession) -> DataFrame:
    return keyword_docs(spark).select(
        F.lit("nested.all").alias("contract_id"), "version", F.lit(NESTED_DOCUMENT).alias("schema_json")
    )


def keyword_docs(spark: SparkSession) -> DataFrame:
    return spark.range(0, 1, 1, 1).select(
        F.lit("kw.all").alias("contract_id"),
        F.lit("v1").alias("version"),
        F.lit(KEYWORD_DOCUMENT).alias("schema_json"),
    )


MALFORMED = "metadata.yaml is no mapping."


def faulty_contracts(spark: SparkSession, sf: str) -> DataFrame:
    rows = contracts(spark, sf).withColumn("fault", customer_key() % 50)
    fault = F.col("fault")
    return (
        rows.filter("fault <> 7")
        .withColumn("owner_team", F.when(fault == 8, " \t").otherwise(F.col("owner_team")))
        .withColumn("domain", F.when(fault == 19, "").otherwise(F.col("domain")))
        .withColumn(
            "compatibility_mode",
            F.when(fault == 9, "SIDEWAYS")
            .when(fault == 20, F.lit(None).cast("string"))
            .otherwise(F.lower("compatibility_mode")),
        )
        .withColumn("contract_id", _odd_id())
        .withColumn("metadata_error", F.when(fault == 22, MALFORMED))
        .drop("fault")
    )


def policy_configs(spark: SparkSession, sf: str) -> DataFrame:
    """A configuration of its own for every customer, many of them wrong."""
    c = F.col("c_custkey")
    first = pick(c, "FIELD_REMOVED", " field-removed", "FIELD_GONE", " ")
    level = pick(c, '"BREAKING"', '"breaking"', "null")
    second = pick(c, "WARNING", "IGNORE", "LOUD", "BREAKING", "")
    text = F.concat(
        F.lit('{"defaultPack":"own","packs":{"none":null,"bare":{},"own":{"rules":{"'),
        first, F.lit('":'), level, F.lit(',"enum_value-added":"'), second, F.lit('"}}}}'),
    )
    return table(spark, sf, "customer").select(
        contract_of("c_custkey").alias("config_id"),
        F.when(c % 7 == 0, "[]").when(c % 11 == 0, "{packs").otherwise(text).alias("text"),
    )


def packs() -> PolicyPacks:
    return PolicyPacks.parse(POLICY_TEXT)


def _iso(time: Column, key: Column | None = None) -> Column:
    tail = F.lit("Z") if key is None else F.when(key % 3 == 0, ".500Z").otherwise("Z")
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), tail)


def _plus_seconds(time: str | Column, seconds: Column) -> Column:
    time = F.col(time) if isinstance(time, str) else time
    return F.timestamp_add("SECOND", seconds.cast("int"), time)


def check_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = numbered_orders(spark, sf)
    key, ver, letter = F.col("o_orderkey"), F.col("ver"), F.col("o_orderstatus")
    status = (
        F.when(letter == "F", "FAIL")
        .when(letter == "P", "PASS")
        .when(key % 2 == 0, "QUEUED")
        .otherwise("RUNNING")
    )
    failed = letter == "F"
    breaking = (
        F.when(failed & (key % 5 == 0), "Field removed: amount | Required field added: region")
        .when(failed & (key % 5 != 1), F.concat(F.lit('["Field removed: f'), key % 7, F.lit('"]')))
        .otherwise("[]")
    )
    warnings = (
        F.when(
            failed & (key % 5 == 1),
            '["Execution error: IllegalStateException: Schema file does not exist"]',
        )
        .when(
            (letter == "P") & (key % 4 == 0),
            F.concat(F.lit('["Enum value added: status.E'), key % 9, F.lit('"]')),
        )
        .otherwise("[]")
    )
    created = _plus_seconds("o_orderdate", key % 86400)
    unstarted = (status == "QUEUED") | (key % 5 == 2)
    return rows.select(
        F.concat(F.lit("run-"), key).alias("run_id"),
        contract_of("c").alias("contract_id"),
        version_of(1 + ver % 3).alias("base_version"),
        version_of(2 + ver % 3).alias("candidate_version"),
        status.alias("status"),
        breaking.alias("breaking_changes"),
        warnings.alias("warnings"),
        F.concat(F.lit("sha-"), key % 100).alias("commit_sha"),
        _iso(created, key).alias("created_at"),
        F.when(key % 7 != 0, "cli").alias("triggered_by"),
        F.when(key % 11 != 0, "BACKWARD").alias("compatibility_mode"),
        F.lit(None).cast("string").alias("input_hash"),
        F.when(~unstarted, _iso(created, key)).alias("started_at"),
        F.when(
            ~unstarted & (status != "RUNNING"), _iso(_plus_seconds(created, key % 97), key)
        ).alias("finished_at"),
    )


def check_run_logs(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    flag, number = F.col("l_returnflag"), F.col("l_linenumber")
    message = (
        F.when(
            flag == "A",
            F.concat(
                F.lit("code=check_run_attempt_failed attempt="),
                number,
                F.lit(" message=IllegalStateException: line "),
                number,
            ),
        )
        .when(
            flag == "N", "code=check_run_completed status=PASS message=Check run completed."
        )
        .otherwise(
            F.concat(
                F.lit("code=check_run_requeued attempt="),
                number,
                F.lit(" maxRetries=2 message=Run re-queued for retry."),
            )
        )
    )
    return lines.select(
        F.concat_ws(
            "-", F.lit("log"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"
        ).alias("log_id"),
        F.concat(F.lit("run-"), "l_orderkey").alias("run_id"),
        F.when(flag == "A", "ERROR").when(flag == "N", "INFO").otherwise("WARN").alias("level"),
        message.alias("message"),
        _iso(_plus_seconds("l_shipdate", F.col("l_partkey") % 86400)).alias("created_at"),
    )


def audit_logs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    action = (
        F.when(kind == "signup", "CONTRACT_CREATE")
        .when(kind == "purchase", "CONTRACT_VERSION_CREATE")
        .otherwise("CHECK_RUN_CREATE")
    )
    return e.select(
        F.concat(F.lit("audit-"), "event_id").alias("audit_id"),
        action.alias("action"),
        F.concat(F.lit("user-"), "user_id").alias("actor"),
        F.lit("USER,WRITER").alias("actor_roles"),
        F.lit("api").alias("source"),
        F.lit(None).cast("string").alias("request_id"),
        F.lit("POST").alias("http_method"),
        F.lit("/checks").alias("path"),
        F.lit("check_run").alias("resource_type"),
        F.when(kind != "error", F.concat(F.lit("res-"), "event_id")).alias("resource_id"),
        F.when(kind == "error", "FAILURE").otherwise("SUCCESS").alias("status"),
        F.when(
            F.col("event_id") % 7 != 0,
            F.concat(F.lit('{"contractId":"cust.'), "user_id", F.lit('"}')),
        ).alias("detail"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias(
            "created_at"
        ),
    )


def payloads_of(events: DataFrame) -> DataFrame:
    """One payload per event; a pure projection, so it works on a stream as well."""
    i, kind = F.col("event_id"), F.col("event_type")
    event_id = (
        F.when(i % 11 == 0, "")
        .when(i % 13 == 0, F.concat(F.lit('"eventId":"'), i, F.lit('",')))
        .when(i % 23 == 0, F.concat(F.lit('"eventId":'), i, F.lit(".0,")))
        .when(i % 29 == 0, F.concat(F.lit('"eventId":'), i, F.lit(".5,")))
        .otherwise(F.concat(F.lit('"eventId":'), i, F.lit(",")))
    )
    body = F.concat(
        F.lit("{"),
        event_id,
        F.lit('"type":"'),
        F.when(i % 17 == 0, "unknown").otherwise(kind),
        F.lit('","value":'),
        F.when(i % 19 == 0, "null").otherwise(F.col("value").cast("string")),
        F.lit(',"props":'),
        "props",
        F.lit("}"),
    )
    return events.select(
        F.when(i % 101 == 0, "events.ghost")
        .otherwise(F.concat(F.lit("events."), kind))
        .alias("contract_id"),
        F.when(i % 3 == 0, "v1.json").otherwise("v1").alias("version"),
        i.cast("string").alias("payload_id"),
        F.when(i % 97 == 0, F.lit(None).cast("string"))
        .when(i % 89 == 0, "{bad")
        .otherwise(body)
        .alias("payload"),
    )


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    return payloads_of(table(spark, sf, "events"))


def event_docs(spark: SparkSession, sf: str) -> DataFrame:
    """A contract per event type found in the table.

    `view` allows a null value by flag; `signup` uses a keyword outside the field model.
    """
    kinds = table(spark, sf, "events").select("event_type").distinct()
    allowed = ",".join(f'"{t}"' for t in EVENT_TYPES)
    value = (
        F.when(F.col("event_type") == "view", '{"type":"number","nullable":true}')
        .when(F.col("event_type") == "signup", '{"type":"number","pattern":"x"}')
        .otherwise('{"type":"number"}')
    )
    return kinds.select(
        F.concat(F.lit("events."), "event_type").alias("contract_id"),
        F.lit("v1").alias("version"),
        F.lit(1).alias("version_num"),
        F.concat(
            F.lit(
                '{"type":"object","properties":{"eventId":{"type":"integer"},'
                f'"type":{{"type":"string","enum":[{allowed}]}},"value":'
            ),
            value,
            F.lit(',"props":{"type":"object"}},"required":["eventId","type","value"]}'),
        ).alias("schema_json"),
    )


def broken_third(docs: DataFrame) -> DataFrame:
    """The documents with an unreadable third version of every tenth contract."""
    broken = (customer_key() % 10 == 8) & (F.col("version") == "v3")
    return docs.withColumn("schema_json", F.when(broken, "{not json").otherwise(F.col("schema_json")))


def check_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests from the queued runs, some of them bad and some sent twice."""
    requests = single_requests(spark, sf)
    again = requests.filter(F.regexp_extract("request_id", "([0-9]+)$", 1).cast("long") % 9 == 0)
    return requests.unionByName(again)


def single_requests(spark: SparkSession, sf: str) -> DataFrame:
    runs = check_runs(spark, sf).filter(F.col("status") == "QUEUED")
    key = F.regexp_extract("run_id", "([0-9]+)$", 1).cast("long")
    fault = customer_key() % 10
    mode = pick(key, "BACKWARD", "FORWARD", "FULL")
    return runs.select(
        F.concat(F.lit("req-"), key).alias("request_id"),
        F.when(fault == 3, F.concat(F.lit("ghost."), customer_key()))
        .otherwise(F.col("contract_id"))
        .alias("contract_id"),
        "base_version",
        F.when(fault == 4, "v99")
        .when(fault == 6, F.col("base_version"))
        .otherwise(F.col("candidate_version"))
        .alias("candidate_version"),
        F.when(fault == 5, "SIDEWAYS")
        .when(key % 4 == 0, F.concat(F.lit(" "), F.lower(mode), F.lit("\t")))
        .otherwise(mode)
        .alias("mode"),
        F.when(key % 10 == 4, "  ").otherwise(F.col("commit_sha")).alias("commit_sha"),
        F.when((fault == 7) & (key % 4 == 2), " ").otherwise("ci").alias("triggered_by"),
    )


def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Changed paths: every third customer's versions, and two kinds that must be ignored."""
    orders = numbered_orders(spark, sf).select("c", "ver")
    c = F.col("c")
    path = F.when(
        c % 3 == 0, F.concat(F.lit("contracts/"), contract_of("c"), F.lit("/v"), "ver", F.lit(".json"))
    ).otherwise(pick(c, "docs/x.md", "contracts/policy-packs.json"))
    return orders.select(path.alias("path"))
