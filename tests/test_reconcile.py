import copy
import json
from collections import Counter

from pyspark.sql import functions as F

from sievelake.operators.reconcile import Container, below, reconcile

PARTS = Container("parts", ("name", "amount"), "name")
PRODUCTS = Container("products", ("number", "brand", "status", "since", "parts"), "number", required=("number",), days=("since",), words={"status": ("on", "off")}, lists=("parts",))


def entry(original, name, path):
    state = "absent" if name not in original else "null" if original[name] is None else "present"
    return {"state": state, "path": f"{path}.{name}", "raw_value": original.get(name)}


def normal(raw, root):
    """What a correct reader makes of a raw record."""

    def value(o, f):
        v = o.get(f)
        return f"{v[:4]}-{v[4:6]}-{v[6:]}" if f == "since" and v else v or None

    out = []
    for i, o in enumerate(raw["products"]):
        path = f"{root}.products[{i}]"
        parts = [{f: value(p, f) for f in PARTS.fields} | {"source_fields": {f: entry(p, f, f"{path}.parts[{j}]") for f in PARTS.fields}} for j, p in enumerate(o.get("parts") or [])]
        out.append({f: value(o, f) for f in PRODUCTS.fields[:-1]} | {"parts": parts, "source_fields": {f: entry(o, f, path) for f in PRODUCTS.fields}})
    return {"products": out[::-1]}


RAW = {"products": [{"number": "001", "brand": "", "status": "on", "since": "20200131", "parts": [{"name": "a", "amount": "1"}, {"name": "b"}]}, {"number": "002", "status": None, "parts": None}]}


def run(spark, cases):
    rows = [(k, json.dumps(doc), json.dumps(raw), f"results[{k}]") for k, (doc, raw) in enumerate(cases)]
    records = spark.createDataFrame(rows, "k int, d string, r string, place string").select("k", F.parse_json("d").alias("doc"), F.parse_json("r").alias("raw"), "place").repartition(3)
    top = reconcile(records, ["k"], PRODUCTS).select("k", "at", "index", "field", "code")
    deep = reconcile(below(records, ["k"], PRODUCTS, at="product"), ["k", "product"], PARTS).select("k", "at", "index", F.concat(F.lit("parts."), "field"), "code")
    return Counter(tuple(r) for r in top.union(deep).collect())


def planted(change, raw=RAW, k=0):
    doc = normal(raw, f"results[{k}]")
    change(doc)
    return copy.deepcopy(doc), raw


def put(path, value):
    def go(doc):
        at, names = doc, path.split("/")
        for n in names[:-1]:
            at = at[int(n)] if n.isdigit() else at[n]
        if value is ...:
            del at[names[-1]]
        else:
            at[int(names[-1]) if names[-1].isdigit() else names[-1]] = value

    return go


FAULTS = [
    (lambda d: None, []),
    (put("products/0/extra", 1), [(0, 1, "", "bad_shape")]),
    (put("products/0/source_fields/brand/more", 1), [(0, 1, "brand", "bad_shape")]),
    (put("products/1/source_fields/brand/path", "results[0].products[0].other"), [(1, 0, "brand", "bad_path")]),
    (put("products/1/source_fields/number/path", "results[0].products[01].number"), [(1, None, "", "bad_path"), (None, 0, "", "no_child")]),
    (put("products/1/status", "maybe"), [(1, 0, "status", "value_differs"), (1, 0, "status", "bad_value")]),
    (put("products/1/source_fields/since/state", "null"), [(1, 0, "since", "bad_state"), (1, 0, "since", "raw_differs"), (1, 0, "since", "value_differs")]),
    (put("products/1/source_fields/brand/state", "lost"), [(1, 0, "brand", "bad_state"), (1, 0, "brand", "raw_differs")]),
    (put("products/0/brand", "x"), [(0, 1, "brand", "value_differs")]),
    (put("products/1/since", "2020-02-01"), [(1, 0, "since", "value_differs")]),
    (put("products", [None]), [(0, None, "", "bad_shape"), (0, None, "", "bad_path"), (None, 0, "", "no_child"), (None, 1, "", "no_child")]),
    (put("products/1/parts/1/source_fields/amount/raw_value", "9"), [(1, 1, "parts.amount", "bad_state"), (1, 1, "parts.amount", "raw_differs")]),
    (put("products/1/parts/0/name", "z"), [(0, 0, "parts.name", "value_differs")]),
    (put("products", 5), [(None, None, "products", "bad_shape"), (None, 0, "", "no_child"), (None, 1, "", "no_child")]),
]


def test_every_planted_fault_is_found_and_nothing_else(spark):
    cases, want = [], Counter()
    for k, (fault, found) in enumerate(FAULTS):
        doc, raw = normal(RAW, f"results[{k}]"), RAW
        text = json.dumps(doc)
        doc = json.loads(text)
        if isinstance(doc, dict):
            fault(doc)
        doc = json.loads(json.dumps(doc).replace("results[0]", f"results[{k}]"))
        cases.append((doc, raw))
        want.update((k, *f) for f in found)
    got = run(spark, cases)
    # a child that isn't an object has faults in each of its fields too; here its own ones are enough
    got = Counter({x: n for x, n in got.items() if not (x[0] == 10 and x[3] not in ("", "products")) and not (x[3].startswith("parts.") and x[0] == 10)})
    # what a wrong index makes of the fields of that child is its own
    got = Counter({x: n for x, n in got.items() if not (x[0] == 4 and x[3].startswith("parts."))})
    assert got == want


def test_repeats_and_missing_raw(spark):
    doc = normal(RAW, "results[0]")
    doc["products"].append(copy.deepcopy(doc["products"][0]))
    got = run(spark, [(doc, RAW), (normal(RAW, "results[1]"), {"products": RAW["products"][:1]}), (normal(RAW, "results[2]"), None)])
    assert {x[1:] for x in got if x[0] == 0 and x[3] == ""} == {(0, 1, "", "repeated_index"), (2, 1, "", "repeated_index"), (0, 1, "", "repeated_key"), (2, 1, "", "repeated_key")}
    assert {x[1:] for x in got if x[0] == 1} == {(0, 1, "", "no_raw")}
    assert {x[1:] for x in got if x[0] == 2 and x[3] == ""} == {(0, 1, "", "no_raw"), (1, 0, "", "no_raw")}


def test_no_children(spark):
    assert not run(spark, [({"products": None}, {"products": None}), ({}, {}), ({"products": []}, {"products": []})])
    records = spark.createDataFrame([], "k int, d string").select("k", F.parse_json("d").alias("doc"), F.parse_json("d").alias("raw"), F.lit("").alias("place"))
    assert reconcile(records, ["k"], PRODUCTS).count() == 0
