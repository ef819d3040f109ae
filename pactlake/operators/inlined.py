"""Few, small schemas as expressions of a payload's row.

A compiled schema (`nested.compile_schemas`) whose references do not lead back into themselves is a finite tree of
visits. Here that tree becomes columns: the places of a payload that it names are read once each, and every assertion is
a condition on them, so a payload is judged in its own row, without a join or a shuffled visit. Items, and members
that a schema does not name, are judged by a function over them.

Documents that are many, large or recursive are left to the tables of `nested`, which judge any.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, functions as F

from pactlake.operators import payloads as flat

#: What is taken into a plan at most: documents, bytes of them, visits with the members they ask for, and levels.
DOCUMENTS, BYTES, VISITS, DEPTH = 16, 1 << 16, 256, 32

_TEXTS = "array<string>"
_SIMPLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Assertions by what must be there for them to be made; those on `bounds` go by their own names.
_ASSERTED = {flat.TYPE: "types", flat.ENUM: "allowed", "const": "const"}
_LOOKS_ON = ("allOf", "$ref", "dependentSchemas")


class _NotInlined(Exception):
    """A schema that has to go by tables."""


@dataclass(frozen=True)
class _Spot:
    """A value and its kind. place: its number, where it stands in columns."""

    value: Column
    kind: Column
    place: int | None = None


@dataclass
class _Places:
    """The places of a payload that schemas name, each read once: (parent, step) to its number."""

    of: dict[tuple[int, str | int], int] = field(default_factory=dict)
    depth: list[int] = field(default_factory=lambda: [0])

    def at(self, place: int) -> _Spot:
        return _Spot(F.col(f"v{place}"), F.col(f"k{place}"), place)

    def below(self, place: int, step: str | int) -> _Spot:
        if (place, step) not in self.of:
            self.of[place, step] = len(self.depth)
            self.depth.append(self.depth[place] + 1)
        return self.at(self.of[place, step])

    def read(self, rows: DataFrame) -> DataFrame:
        """The rows, which have v0 and k0, with the value and kind of every place."""
        for depth in range(1, max(self.depth) + 1):
            here = {n: key for key, n in self.of.items() if self.depth[n] == depth}
            rows = rows.withColumns({f"v{n}": _step(F.col(f"v{parent}"), step) for n, (parent, step) in here.items()})
            rows = rows.withColumns({f"k{n}": flat.kind(F.col(f"v{n}")) for n in here})
        return rows


@dataclass(frozen=True)
class Inlined:
    """Documents as expressions: (contract_id, version, violations), the violations being null where the document is no
    JSON; and the places that they read."""

    documents: list[tuple[str, str, Column | None]]
    places: _Places

    def check(self, rows: DataFrame) -> DataFrame:
        """Rows with contract_id, version and payload, and their violations."""
        tree = rows.withColumn("v0", F.try_parse_json("payload"))
        tree = self.places.read(tree.withColumn("k0", flat.kind(F.col("v0"))))
        malformed = F.array(F.lit(flat.PAYLOAD_MALFORMED))
        found = F.when(F.col("payload").isNull(), F.array(F.lit(flat.PAYLOAD_NULL)))
        for contract, version, violations in self.documents:
            asked = (F.col("contract_id") == F.lit(contract)) & (F.col("version") == F.lit(version))
            judged = malformed if violations is None else F.when(F.col("v0").isNull(), malformed).otherwise(violations)
            found = found.when(asked, judged)
        found = found.otherwise(F.array(F.lit(flat.CONTRACT_UNKNOWN)))
        # What is not broken has left a null.
        found = F.array_except(found, F.array(F.lit(None).cast("string")))
        return tree.select(*rows.columns, F.sort_array(found).alias("violations"))


def inline(docs: DataFrame, roots: DataFrame, edges: DataFrame, odd: DataFrame) -> Inlined | None:
    """The documents as expressions, or nothing if they are too many, too large or recursive. edges: with `usual`, whether
    their pattern can be handed to Spark, and `rests`, those of `patterns` that can."""
    of = ["contract_id", "version"]
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("schema_json"))).first()
    if size[0] > DOCUMENTS or (size[1] or 0) > BYTES:
        return None
    known = [(r[0], r[1]) for r in docs.select(*of).collect()]
    if len(set(known)) < len(known):
        return None
    # No more rows than documents of that size have subschemas.
    root = {(r.contract_id, r.version): r.info for r in roots.collect()}
    said = {(r.contract_id, r.version): r.codes for r in odd.collect()}
    below: dict[tuple, list[Row]] = {}
    for edge in edges.collect():
        below.setdefault((edge.contract_id, edge.version, edge.node), []).append(edge)
    places, left = _Places(), [VISITS]
    try:
        documents = []
        for key in known:
            violations = None
            if key in root:
                tree = _Tree(lambda node, key=key: below.get((*key, node), []), places, left)
                violations = tree.codes("#", root[key], places.at(0), F.lit("#"), "false", ("#",))
                violations = F.concat(violations, _texts(said.get(key) or []))
            documents.append((*key, violations))
    except _NotInlined:
        return None
    return Inlined(documents, places)


def _texts(texts: list[str] = ()) -> Column:
    return F.array(*[F.lit(t) for t in texts]).cast(_TEXTS)


def _step(value: Column, step: str | int) -> Column:
    """A member or an item; null when absent."""
    if isinstance(step, int):
        return F.try_variant_get(value, f"$[{step}]", "variant")
    if _SIMPLE.match(step):
        return F.try_variant_get(value, f"$.{step}", "variant")
    return F.try_element_at(value.try_cast("map<string,variant>"), F.lit(step))


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def _escaped(step: Column) -> Column:
    return F.replace(F.replace(step, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


class _Tree:
    """Visits of one document, as violations and nulls (`codes`) or as whether there are any (`broken`)."""

    def __init__(self, below: Callable[[str], list[Row]], places: _Places, left: list[int]):
        self.below, self.places, self.left = below, places, left
        self.above: list[str] = []

    def codes(self, node: str, info: Row, at: _Spot, path: Column, via: str, seen: tuple[str, ...]) -> Column:
        own, parts = self._judged(node, info, at, path, via, seen, self.codes, self._codes_each)
        own = F.array(*[F.when(c, code) for c, code in own]).cast(_TEXTS)
        return self._unless_null(info, at, F.concat(own, *[F.coalesce(p, _texts()) for p in parts]), _texts())

    def broken(self, node: str, info: Row, at: _Spot, path: Column, via: str, seen: tuple[str, ...]) -> Column:
        own, parts = self._judged(node, info, at, path, via, seen, self.broken, self._broken_each)
        return self._unless_null(info, at, _any([c for c, _ in own] + parts), F.lit(False))

    def _unless_null(self, info: Row, at: _Spot, found: Column, nothing: Column) -> Column:
        return F.when(at.kind == "VOID", nothing).otherwise(found) if info.nullable and not info.never else found

    def _codes_each(self, entries: Column, one: Callable) -> Column:
        return F.flatten(F.transform(entries, one))

    def _broken_each(self, entries: Column, one: Callable) -> Column:
        return F.exists(entries, one)

    def _judged(self, node, info, at, path, via, seen, render, each):
        """([(condition, code)], parts): what a visit breaks by itself, and what its visits below bring."""
        dependent = [(d["key"], [None] if d["value"] is None else d["value"]) for d in info.dependent or []]
        members = [*info.required, *(n for _, names in dependent for n in names)]
        self.left[0] -= 1 + len(members)
        if self.left[0] < 0 or len(self.above) == DEPTH or node in self.above or None in members:
            raise _NotInlined
        if info.never:
            return [(F.lit(True), F.concat(F.lit(f"{via}:"), path))], []
        own, parts = self._own(info, dependent, at, path), []
        self.above.append(node)
        looks: dict[str, list[Row]] = {}
        for edge in self.below(node):
            kind = edge.kind
            if kind in ("properties", "prefixItems"):
                parts.append(self._named(edge, at, path, render))
            elif kind in ("patternProperties", "additionalProperties"):
                parts.append(self._members(edge, at, path, render, each))
            elif kind == "items":
                parts.append(self._items(edge, at, path, render, each))
            elif kind == "contains":
                good = F.filter(self._spots(at), lambda s: ~self.broken(edge.child, edge.info, _of(s), path, kind, (edge.child,)))
                most = F.lit(False) if info.max_contains is None else F.size(good) > info.max_contains
                wrong = (at.kind == "ARRAY") & ((F.size(good) < info.min_contains) | most)
                own.append((wrong, _code("contains", path)))
            elif kind == "propertyNames":
                names = F.transform(F.map_keys(_members_of(at)), lambda n: F.struct(n.cast("variant").alias("v"), F.lit("STRING").alias("k")))
                bad = F.exists(names, lambda s: self.broken(edge.child, edge.info, _of(s), path, kind, (edge.child,)))
                own.append((bad, _code("propertyNames", path)))
            # A reference that leads back to itself on one value adds nothing.
            elif edge.child not in seen:
                looks.setdefault(kind, []).append(edge)

        def on(edge: Row, how: Callable) -> Column:
            return how(edge.child, edge.info, at, path, edge.kind, (*seen, edge.child))

        nothing = _texts() if render == self.codes else F.lit(False)
        for kind in _LOOKS_ON:
            for edge in looks.get(kind, []):
                found = on(edge, render)
                parts.append(F.when(self._has(at, edge.arg), found).otherwise(nothing) if kind == "dependentSchemas" else found)
        if "anyOf" in looks:
            bad = [on(e, self.broken) for e in looks["anyOf"]]
            own.append((reduce(Column.__and__, bad), _code("anyOf", path)))
        if "oneOf" in looks:
            good = [F.when(on(e, self.broken), 0).otherwise(1) for e in looks["oneOf"]]
            own.append((reduce(Column.__add__, good) != 1, _code("oneOf", path)))
        if "not" in looks:
            own.append((~on(looks["not"][0], self.broken), _code("not", path)))
        if "if" in looks:
            then, other = (on(looks[b][0], render) if b in looks else nothing for b in ("then", "else"))
            parts.append(F.when(on(looks["if"][0], self.broken), other).otherwise(then))
        self.above.pop()
        return own, parts

    def _own(self, info: Row, dependent: list[tuple[str, list[str]]], at: _Spot, path: Column) -> list[tuple[Column, Column]]:
        """What a node asserts of a value by itself."""
        bounds = {name: F.lit(info.bounds[name]).cast(kind) for name, kind in flat.BOUNDS}
        f = {
            "types": _texts(info.types or []), "allowed": _texts(info.allowed or []), "const": F.lit(info.const).cast("string"),
            "item_types": F.lit(None).cast(_TEXTS), "bounds": bounds,
        }
        out = []
        for code, wrong in flat.member_checks(f, at.value, at.kind):
            there = code in _ASSERTED and info[_ASSERTED[code]] is not None
            there = there or (code in info.bounds and info.bounds[code] is not None)
            if there:
                out.append((self._types(info.types, at) if code == flat.TYPE else wrong, _code(code, path)))
        members = at.kind == "OBJECT"
        out += [(members & ~self._has(at, n), _member_code("required", path, n)) for n in info.required]
        for name, names in dependent:
            there = members & self._has(at, name)
            out += [(there & ~self._has(at, n), _member_code("dependentRequired", path, n)) for n in names]
        if info.pattern is not None:
            text = F.when(at.kind == "STRING", at.value.try_cast("string"))
            out.append((~F.regexp_like(text, F.lit(info.pattern)), _code("pattern", path)))
        return out

    def _types(self, types: list[str], at: _Spot) -> Column:
        if None in types:
            raise _NotInlined
        return ~_any([flat._type_matches(at.value, at.kind, F.lit(t)) for t in types])

    def _has(self, at: _Spot, name: str) -> Column:
        if at.place is None:
            return F.coalesce(F.array_contains(F.map_keys(_members_of(at)), name), F.lit(False))
        return self.places.below(at.place, name).value.isNotNull()

    def _named(self, edge: Row, at: _Spot, path: Column, render: Callable) -> Column:
        """A member or an item that has its place."""
        asked = "OBJECT" if edge.kind == "properties" else "ARRAY"
        step = edge.arg if edge.kind == "properties" else edge.ord
        name = str(step).replace("~", "~0").replace("/", "~1")
        path = F.concat(path, F.lit(f"/{name}"))

        def judged(spot: _Spot) -> Column:
            found = render(edge.child, edge.info, spot, path, edge.kind, (edge.child,))
            return F.when((at.kind == asked) & spot.value.isNotNull(), found)

        if at.place is not None:
            return judged(self.places.below(at.place, step))
        value = _step(at.value, step)
        spot = F.array(F.struct(value.alias("v"), flat.kind(value).alias("k")))
        return F.get(F.transform(spot, lambda s: judged(_of(s))), F.lit(0))

    def _members(self, edge: Row, at: _Spot, path: Column, render: Callable, each: Callable) -> Column:
        entries = F.map_entries(_members_of(at))
        if edge.kind == "patternProperties":
            if not edge.usual:
                return F.lit(None).cast(_TEXTS if render == self.codes else "boolean")
            entries = F.filter(entries, lambda e: F.regexp_like(e["key"], F.lit(edge.arg)))
        else:
            like = lambda n: _any([F.regexp_like(n, F.lit(p)) for p in edge.rests])
            entries = F.filter(entries, lambda e: ~F.array_contains(_texts(edge.names), e["key"]) & ~like(e["key"]))
        spots = F.transform(entries, lambda e: F.struct(e["key"].alias("step"), e["value"].alias("v"), flat.kind(e["value"]).alias("k")))
        return each(spots, self._stepped(edge, path, render))

    def _items(self, edge: Row, at: _Spot, path: Column, render: Callable, each: Callable) -> Column:
        spots = F.filter(self._spots(at), lambda s: s["step"].cast("int") >= edge.skip) if edge.skip else self._spots(at)
        return each(spots, self._stepped(edge, path, render))

    def _stepped(self, edge: Row, path: Column, render: Callable) -> Callable:
        def one(s: Column) -> Column:
            return render(edge.child, edge.info, _of(s), F.concat(path, F.lit("/"), _escaped(s["step"])), edge.kind, (edge.child,))

        return one

    def _spots(self, at: _Spot) -> Column:
        items = F.when(at.kind == "ARRAY", at.value.try_cast("array<variant>"))
        return F.transform(items, lambda v, i: F.struct(i.cast("string").alias("step"), v.alias("v"), flat.kind(v).alias("k")))


def _of(spot: Column) -> _Spot:
    return _Spot(spot["v"], spot["k"])


def _members_of(at: _Spot) -> Column:
    return F.when(at.kind == "OBJECT", at.value.try_cast("map<string,variant>"))


def _code(keyword: str, path: Column) -> Column:
    return F.concat(F.lit(f"{keyword}:"), path)


def _member_code(keyword: str, path: Column, name: str) -> Column:
    return F.concat(F.lit(f"{keyword}:"), path, F.lit(f"/{name}"))
