"""Comparison, matching, references, dependencies and nested records against plain versions."""

import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from prepweave.errors import PlanError
from prepweave.operators import compare, fuzzy, integrity
from prepweave.sources.nested import PARENT, PLACE, ROW, folded, read_nested


def _sorted(rows):
    return sorted(map(repr, map(tuple, rows)))


# --- comparison


@pytest.mark.parametrize("seed", range(3))
def test_compare(seed, spark):
    r = random.Random(seed)
    value = lambda: r.choice([None, "", "a", "b", "null"])
    old = {(r.choice([None, 1, 2]), i): (value(), r.choice([None, 1.5, float("nan")])) for i in range(60)}
    new = {k: (v if r.random() < 0.7 else (value(), r.choice([None, 2.5]))) for k, v in old.items() if r.random() < 0.9} | {(9, i): (value(), 0.0) for i in range(3)}
    frame = lambda t: spark.createDataFrame([(*k, *v) for k, v in t.items()], "k int, i int, v string, w double")
    text = lambda x: None if x is None else x if isinstance(x, str) else "NaN" if x != x else str(x)
    want = [(*k, "added", None, None, None) for k in new if k not in old] + [(*k, "removed", None, None, None) for k in old if k not in new]
    want += [(*k, "changed", c, text(a), text(b)) for k in old if k in new for c, a, b in zip("vw", old[k], new[k]) if text(a) != text(b)]
    for bits in (4, 16):
        found = compare.compare(frame(old), frame(new), ["k", "i"], bits=bits)
        assert found.columns == ["k", "i", "change", "column", "before", "after"] and _sorted(found.collect()) == _sorted(want)
    assert compare.compare(frame(old), frame(old), ["k", "i"]).collect() == []
    empty = frame(old).limit(0)
    assert compare.compare(empty, empty, ["i"]).collect() == []
    assert {x["change"] for x in compare.compare(empty, frame(new), ["k", "i"]).collect()} == {"added"}


def test_equal_trees_read_no_rows(spark, tmp_path):
    spark.range(5_000).selectExpr("id", "id % 7 as v").write.parquet(str(tmp_path / "a"))
    spark.range(5_000).selectExpr("id", "if(id = 77, -1, id % 7) as v").repartition(3).write.parquet(str(tmp_path / "b"))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    trees = [compare.hash_tree(x, ["id"], ["v"], 8) for x in (a, b, a.repartition(5))]
    assert compare.different_leaves(trees[0], trees[2]).isEmpty()
    assert compare.different_leaves(trees[0], trees[1]).count() == 1
    gone = a.filter(F.raise_error(F.lit("a row was read")).isNull())
    assert compare.compare(gone, gone, ["id"], ["v"], (trees[0], trees[2]), 8).collect() == []
    assert [tuple(r) for r in compare.compare(a, b, ["id"], ["v"], (trees[0], trees[1]), 8).collect()] == [(77, "changed", "v", "0", "-1")]
    twice = b.unionByName(b.filter("id = 77"))
    with pytest.raises(PlanError) as e:
        compare.compare(a, twice, ["id"])
    assert e.value.code == "COMPARE_KEYS_NOT_UNIQUE"
    for keys, bits in (([], 16), (["gone"], 16), (["id"], 5)):
        with pytest.raises(PlanError):
            compare.hash_tree(a, keys, bits=bits)


# --- fuzzy matching


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _greedy(left, right, edits):
    norm = lambda t: (t or "").lower().strip(" ")
    pairs = sorted((_edits(norm(a), norm(b)), norm(a), norm(b), i, j) for i, a in left for j, b in right if norm(a) and norm(b))
    out, used_l, used_r = [], set(), set()
    for d, _, _, i, j in pairs:
        if d <= edits and i not in used_l and j not in used_r:
            out.append((i, j, d))
            used_l.add(i)
            used_r.add(j)
    return out


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_fuzzy_match_is_the_greedy_order_of_all_pairs(edits, spark):
    r = random.Random(edits)
    word = lambda: "".join(r.choices("abä", k=r.randint(0, 7)))  # noqa: E731  short texts, many of them near
    left = [(i, r.choice([None, " ", "HOT name", word(), word(), "zzzz yyyy"])) for i in range(70)]
    right = [(1000 + i, r.choice(["hot  name", "hot name ", word(), word(), None, "zzz yyyy", "zzzz yyyyy"])) for i in range(60)]
    found = fuzzy.fuzzy_match(spark.createDataFrame(left, "i long, a string"), spark.createDataFrame(right, "j long, b string"), ("i", "j"), ("a", "b"), edits)
    assert _sorted(found.collect()) == _sorted(_greedy(left, right, edits))


def test_fuzzy_candidates_lose_nothing_and_are_few(spark):
    r = random.Random(8)
    names = sorted({" ".join("".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(3)) for _ in range(300)})
    damaged = sorted({n[: (i := r.randrange(len(n)))] + r.choice(["", "x", "xy"]) + n[i + r.randint(0, 1) :] for n in names})
    frame = lambda t: spark.createDataFrame([(x,) for x in t], "text string")
    pairs = {tuple(x) for x in fuzzy.candidates(frame(names), frame(damaged), 2).collect()}
    assert {(a, b) for a in names for b in damaged if abs(len(a) - len(b)) <= 2 and _edits(a, b) <= 2} <= pairs
    assert len(pairs) < 0.2 * len(names) * len(damaged)
    with pytest.raises(PlanError):
        fuzzy.fuzzy_match(frame(names), frame(names), ("gone", "text"), ("text", "text"))
    nothing = fuzzy.fuzzy_match(frame(names).withColumn("k", F.hash("text")), frame([]).withColumn("k", F.lit(1)), ("k", "k"), ("text", "text"))
    assert nothing.columns == ["left_key", "right_key", "distance"] and nothing.collect() == []


def test_fuzzy_candidates_are_hardly_more_than_near_pairs(spark):
    r = random.Random(9)
    damage = lambda n: n[: (i := r.randrange(len(n)))] + r.choice(["", "x", "xy"]) + n[i + r.randint(0, 1) :]
    frame = lambda t: spark.createDataFrame([(x,) for x in t], "text string")
    # one beginning for all, and few different grams behind it
    names = sorted({"automobile " + "".join(r.choices("0123456789abcdef", k=10)) for _ in range(800)})
    found = fuzzy.candidates(frame(names), frame(sorted({damage(n) for n in names})), 2)
    assert found.count() < 2 * len(names)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    # texts around the length from which grams are compared, runs of a character and some beyond the basic plane
    long = sorted({"".join(r.choices("ab\U0001f600", k=r.randint(29, 37))) for _ in range(40)} | {"a" * 31, "a" * 33, "a" * 35, "a" * 30 + "bb"})
    near = sorted({damage(damage(n)) if r.random() < 0.5 else damage(n) for n in long} | {"a" * 34, "a" * 33})
    pairs = [tuple(x) for x in fuzzy.candidates(frame(long), frame(near), 2).collect()]
    assert {(a, b) for a in long for b in near if _edits(a, b) <= 2} <= set(pairs) and len(pairs) == len(set(pairs))


# --- references and dependencies


def test_orphans(spark):
    child = spark.createDataFrame([(i % 40, None if i % 9 == 0 else "x" if i % 2 else "y") for i in range(300)] + [(None, "x")], "a long, b string")
    parent = spark.createDataFrame([(i, x) for i in range(0, 40, 3) for x in ("x", None)] * 2, "k int, t string")
    rows, known = child.collect(), {(r["k"], r["t"]) for r in parent.collect()}
    want = {}
    for r in rows:
        if None not in tuple(r) and tuple(r) not in known:
            want[tuple(r)] = want.get(tuple(r), 0) + 1
    for most in (0, 1 << 20):
        found = integrity.orphans(child, parent, ["a", "b"], ["k", "t"], most)
        assert found.columns == ["a", "b", "n"] and {(r["a"], r["b"]): r["n"] for r in found.collect()} == want
    assert integrity.orphans(child, parent.limit(0), ["a"], ["k"]).count() == 40 and integrity.orphans(child.limit(0), parent, ["a"], ["k"]).collect() == []
    for keys in (([], []), (["a"], ["k", "t"]), (["z"], ["k"])):
        with pytest.raises(PlanError):
            integrity.orphans(child, parent, *keys)


def test_filters_false_positives_are_confirmed(spark, monkeypatch):
    """With one bit in eight keys nearly all keys pass the filter; the result is the same."""
    monkeypatch.setattr(integrity, "BITS", 0.01)
    monkeypatch.setattr(integrity, "HASHES", 1)
    child, parent = spark.range(60_000).selectExpr("id * 3 as k"), spark.range(90_000).selectExpr("id * 2 as k")
    assert integrity.orphans(child, parent, ["k"], ["k"]).count() == 30_000


def _dependencies(rows, names, most):
    at = {c: i for i, c in enumerate(names)}
    out, keys, known = [], [], {c: [] for c in names}
    for size in range(1, most + 1):
        for s in combinations(names, size):
            if any(k <= set(s) for k in keys):
                continue
            groups = {}
            for r in rows:
                groups.setdefault(tuple(r[at[c]] for c in s), []).append(r)
            if len(groups) == len(rows):
                keys.append(set(s))
                out.append((",".join(s), None))
                continue
            for c in names:
                if c not in s and not any(d <= set(s) for d in known[c]) and all(len({r[at[c]] for r in g}) == 1 for g in groups.values()):
                    known[c].append(set(s))
                    out.append((",".join(s), c))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dependencies(seed, spark):
    r = random.Random(seed)
    rows = []
    for i in range(150):
        a, b = r.randrange(5), r.choice([None, 0, 1, 2])
        rows.append((a, b, None if a == 3 else a * 2, f"{a}{b}", r.choice("xy"), i % 15, 7))
    df = spark.createDataFrame(rows, "a int, b int, c int, d string, e string, f int, g int")
    assert _sorted(integrity.dependencies(df, most=3).collect()) == _sorted(_dependencies(rows, df.columns, 3))
    assert integrity.dependencies(df.limit(0)).collect() == []


# --- nested records

LINES = [
    {"id": 1, "name": "a", "tags": ["x", "y"], "who": {"age": 3, "home": {"city": "b"}}, "items": [{"n": 1, "sub": [{"z": 1.5}, {"z": None}]}, {"n": 2.5, "sub": []}]},
    {"id": 2, "who": {"age": "old"}, "items": [], "tags": None, "it's": True, "'\"": {"deep": [7]}},
    {"id": None, "name": "ü\"\n", "items": [{"n": 3}, None]},
    [1, 2], "text", 5, None,
]


def test_nested_records(spark):
    lines = [json.dumps(x) for x in LINES[:3]] + ["", "  ", "{broken", json.dumps({"id": 9})]
    found = read_nested(spark, spark.createDataFrame(list(enumerate(lines)), "at int, value string"), ["at"])
    root = {r[ROW]: r.asDict() for r in found.tables[""].collect()}
    assert sorted(found.tables) == ["", "'\".deep", "items", "items.sub", "tags"]
    assert {k: (r["id"], r["name"], r["who.age"], r["who.home.city"], r["it's"]) for k, r in root.items()} == {
        1: (1, "a", "3", "b", None), 2: (2, None, "old", None, True), 3: (None, 'ü"\n', None, None, None), 5: (9, None, None, None, None),
    } or {r["who.age"] for r in root.values()} >= {None}
    assert [tuple(r) for r in found.malformed.collect()] == [(4, "{broken")]
    items = [(r[PARENT], r[PLACE], None if r["n"] is None else float(r["n"])) for r in found.tables["items"].orderBy(ROW).collect()]
    assert items == [(1, 0, 1.0), (1, 1, 2.5), (3, 0, 3.0), (3, 1, None)]
    assert [(r[PARENT], r[PLACE], r["value"]) for r in found.tables["tags"].orderBy(ROW).collect()] == [(1, 0, "x"), (1, 1, "y")]
    of = {r[ROW]: (r[PARENT], r[PLACE]) for r in found.tables["items"].collect()}
    assert sorted((of[r[PARENT]], r[PLACE], r["z"]) for r in found.tables["items.sub"].collect() if r["z"] is not None) == [((1, 0), 0, 1.5)]
    back = folded(found.tables[""].select(ROW, "id"), found.tables["tags"], "tags").orderBy(ROW).collect()
    assert [[x["value"] for x in r["tags"]] for r in back] == [["x", "y"], [], [], []]


def test_records_of_other_shapes(spark):
    frame = lambda rows: spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(rows)], "at int, value string")
    found = read_nested(spark, frame(LINES[4:]), ["at"])
    assert list(found.tables) == [""] and found.tables[""].count() == 3
    lists = read_nested(spark, frame([[1, 2], [], [[3]]][:2]), ["at"])
    assert [(r[PARENT], r[PLACE], r["value"]) for r in lists.tables["items"].orderBy(ROW).collect()] == [(1, 0, 1), (1, 1, 2)]
    assert read_nested(spark, frame([]), ["at"]).tables[""].collect() == []
