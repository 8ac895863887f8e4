"""Which exclusion rules others make redundant, against comparing all pairs."""

import random
import re

from shelfsift.operators.filters import rule_supersedes


def _covers(outer, inner):
    (path_o, rec_o), (path_i, rec_i) = outer, inner
    key = lambda p: p.replace("\\", "/").rstrip("/").upper()
    o, i = key(path_o), key(path_i)
    wild = lambda p: "*" in p or "?" in p
    if o == i:
        return (path_o, rec_o) != (path_i, rec_i) and (rec_o or not rec_i)
    if not rec_o or wild(i):
        return False
    if not wild(o):
        return i.startswith(o + "/") and bool(o)
    bare = o[:-2] if o.endswith("/*") else o
    whole = lambda p: re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p), i, re.S)
    return any(whole(p) for p in (o, o + "/*", bare, bare + "/*"))


def test_rules_are_compared_like_all_pairs(spark):
    rng = random.Random(6)
    names = ["lib", "TV", "Extras", "a", "Season 03", "temp.files"]
    rules = {("*", True), ("*/*", True), ("?ib*", True), ("*/extras", True), ("*/season 0?/*", True), ("/l*", True), ("*mp.f*", True), ("*a", False), ("?", True)}
    for _ in range(60):
        path = "/" + "/".join(rng.choice(names) for _ in range(rng.randrange(1, 4)))
        if rng.random() < 0.3:
            at = rng.randrange(len(path))
            path = path[:at] + rng.choice("*?") + path[at + 1 :]
        rules.add((path + rng.choice(["", "", "/", "/*"]), rng.random() < 0.7))
    rules = sorted(rules)
    df = spark.createDataFrame(rules, "path string, include_subdirectories boolean")
    found = rule_supersedes(df)
    assert {tuple(r) for r in found.collect()} == {(o[0], i[0]) for o in rules for i in rules if o != i and _covers(o, i)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
