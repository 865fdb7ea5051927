"""Dictionaries from files: open alias lists against brute force, results that follow the file."""

import json
import random

from pyspark.sql import functions as F

from bandwise.functions.fuzzy import with_color
from bandwise.operators import dictionaries as D
from bandwise.sources import files

WORDS = ["guards", "red", "rot", "slate", "grey", "blue", "biscay", "metallic", "dark", "light", "é", "x", "irish", "green", "night"]


def ratio(a, b):
    """Token-sort ratio by the plain table of common subsequences."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return 200.0 * row[-1] / (len(a) + len(b))


def drawn(rng, n, most):
    out = set()
    while len(out) < n:
        name = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, most)))
        if rng.random() < 0.5:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("abcde") + name[at + 1:]
        out.add(name.strip())
    return sorted(x for x in out if x)


def test_closest_names_are_those_of_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    names, keys = drawn(rng, 260, 4) + drawn(rng, 12, 20), drawn(rng, 200, 4) + drawn(rng, 6, 20) + ["zzzz"]
    names = list(dict.fromkeys(names))
    rng.shuffle(names)
    assert max(map(len, names)) > 64
    want = {}
    for key in keys:
        for tier in (0, 1):
            scored = [(ratio(key, n), -k, n) for k, n in enumerate(names) if k % 2 == tier]
            top = max(scored, default=(0, 0, None))
            if top[0] >= 70:
                want[key, tier] = (top[2], round(top[0], 9))
    table = spark.createDataFrame([(n, k % 2, k) for k, n in enumerate(names)], "name string, tier int, rank long")
    asked = spark.createDataFrame([(k,) for k in keys], "key string").distinct()
    for block, some in ((5_000, 2_000), (50, 30)):
        monkeypatch.setattr(D, "BLOCK", block)
        monkeypatch.setattr(D, "SLICE", some)
        got = {(r.key, r.tier): (r.name, round(r.score, 9)) for r in D.closest_names(asked, table).collect()}
        assert got == want
    assert 0.2 < len(want) / (2 * len(keys)) < 1
    assert D.closest_names(asked.limit(0), table).count() == 0 and D.closest_names(asked, table.limit(0)).count() == 0


def test_many_names_against_many(spark):
    """5,000 names against 5,000: each finds its altered twin or one as close."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = ["".join(rng.choice(letters) for _ in range(rng.randint(10, 16))) for _ in range(5_000)]
    keys = [n[:4] + n[5:] for n in names]
    table = spark.createDataFrame([(n, 0, k) for k, n in enumerate(names)], "name string, tier int, rank long")
    got = {r.key: r for r in D.closest_names(spark.createDataFrame([(k,) for k in keys], "key string"), table).collect()}
    for name, key in zip(names, keys, strict=True):
        assert got[key].score >= ratio(name, key) and round(ratio(got[key].name, key), 9) == round(got[key].score, 9)
    plan = D.closest_names(table.select(F.col("name").alias("key")), table)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Cartesian" not in plan


def test_the_result_follows_the_file(spark, tmp_path):
    fixed = {"red": ["guards red", "rot"], "blue": ["night blue"], "black": ["night blue", "schwarz"]}
    rows = spark.createDataFrame([(k, c, y, t) for k, (c, y, t) in enumerate([
        ("Rot ", 1970, ""), ("gards red", 1989, "a 964 here"), ("NIGHT BLUE", 1989, None), ("turquoise", 1960, ""), ("qqqqqq", None, ""), ("  ", 1971, ""), (None, 1970, "")])],
        "k int, paint string, year int, words string")

    def resolved(aliases, years):
        (tmp_path / "a.json").write_text(json.dumps({"aliases": aliases}))
        (tmp_path / "y.json").write_text(json.dumps(years))
        out = D.with_color_of(rows, F.col("paint"), files.alias_table(spark, str(tmp_path / "a.json")), "color", "score")
        out = D.with_generation_of(out, "year", F.col("words"), files.year_table(spark, str(tmp_path / "y.json")), "generation")
        assert out.columns == ["k", "paint", "year", "words", "color", "score", "generation"]
        return [(r.color, r.score, r.generation) for r in out.orderBy("k").collect()]

    years = {"year_to_generation": {"1970": "G1", "1971": "G1", "1989": "G4"}, "shared_years": {"1989": {"earlier": "G4", "later": "G5", "words": ["964"]}}}
    first = resolved(fixed, years)
    assert first == [("red", 1.0, "G1"), ("red", 0.95, "G5"), ("black", 1.0, "G4"), ("turquoise", 1.0, None), ("other", 0.0, None), (None, 0.0, "G1"), (None, 0.0, "G1")]
    changed = resolved(fixed | {"green": ["rot"]}, {"year_to_generation": {"1970": "G9"}, "shared_years": {}})
    assert [r[0] for r in changed][:2] == ["green", "red"] and [r[2] for r in changed] == ["G9", None, None, None, None, None, "G9"]


def test_the_fixed_dictionary_as_a_table_gives_the_same_colours(spark):
    from bandwise.functions.fuzzy import alias_map

    rng = random.Random(5)
    rows = spark.createDataFrame([(k, n) for k, n in enumerate([*drawn(rng, 120, 3), "", None, "other"])], "k int, paint string")
    table = spark.createDataFrame([(a, c, k) for k, (a, c) in enumerate(alias_map().items())], "alias string, canonical string, rank long")
    one = with_color(rows, F.col("paint"), "color", "score").collect()
    two = D.with_color_of(rows, F.col("paint"), table, "color", "score").collect()
    assert {r.k: (r.color, r.score) for r in one} == {r.k: (r.color, r.score) for r in two}
