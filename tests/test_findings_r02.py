"""What a review found at larger sizes, on small tables."""

import random

from pyspark.sql.classic.dataframe import DataFrame

from sparkforest.operators import drift
from sparkforest.operators import euler as U
from sparkforest.operators import traverse as T
from sparkforest.operators import trees as R
from sparkforest.plans import scale
from sparkforest.plans.scale import rounds_only
from tests.test_graph import graph, random_graph


def pushed(pairs, alone=()):
    """Depth-first search with an explicit stack, all neighbours pushed in ascending order."""
    near = {x: set() for x in alone}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = {}
    for r in sorted(near):
        stack = [(r, r)]
        while stack:
            x, p = stack.pop()
            if x not in out:
                out[x] = (x, p, len(out))
                stack += [(y, x) for y in sorted(near[x]) if y not in out]
    return sorted(out.values(), key=repr)


def test_depth_first_search_has_no_largest_graph(spark, table_rows):
    path = [(i, i + 1) for i in range(1000, 3000)]
    star = [(5000, x) for x in range(5001, 5100)]
    for pairs in (random_graph(8), random_graph(9, 200, 900), path + star):
        e = graph(spark, pairs)
        alone = spark.createDataFrame([(-7,), (999_999,)], "id bigint")
        want = pushed(pairs, (-7, 999_999))
        assert table_rows(T.dfs_forest(e, alone)) == want
        with rounds_only():  # no graph counts as small
            assert table_rows(T.dfs_forest(e, alone)) == want
            assert R.validate_forest(T.dfs_forest(e).select("id", "parent"), e).first()["valid"]
    none = graph(spark, path).limit(0)
    with rounds_only():
        assert T.dfs_forest(none).count() == 0
        assert table_rows(T.dfs_forest(none, spark.createDataFrame([(3,)], "id bigint"))) == [(3, 3, 0)]


def test_lists_are_ranked_by_shortening_them(spark, table_rows, monkeypatch):
    r = random.Random(4)
    names = r.sample(range(-500, 5000), 1500)
    lists = [names[:1], names[1:3], names[3:400], names[400:]]
    rows = [(x, y) for own in lists for x, y in zip(own, [*own[1:], None])]
    want = sorted(((x, len(own) - 1 - i) for own in lists for i, x in enumerate(own)), key=repr)
    df = spark.createDataFrame(rows, "id bigint, next bigint")
    assert table_rows(R.list_ranks(df)) == want
    monkeypatch.setattr(scale, "SMALL_ROWS", 700)
    moved = []
    counted = R.cut_counted
    monkeypatch.setattr(R, "cut_counted", lambda df, **c: (moved.append(counted(df, **c)), moved[-1])[1])
    assert table_rows(R.list_ranks(df, False, True)) == want  # three or four rounds, the rest in one task
    # Every round moves fewer rows; pointer doubling moved nearly all of them in each.
    sizes = [n["rows"] for _, n in moved]
    assert len(sizes) > 2 and all(b < 0.85 * a for a, b in zip(sizes, sizes[1:]))


def test_tour_is_ranked_to_the_end_by_rounds(spark, table_rows):
    path = [(i, i + 1) for i in range(60)]
    e = graph(spark, path)
    roots = spark.createDataFrame([(30,)], "id bigint")
    ids = spark.createDataFrame([(x,) for x in [*range(61), 99]], "id bigint")
    want = sorted([(30, 30), (99, 99), *((x, x + (1 if x < 30 else -1)) for x in range(61) if x != 30)], key=repr)
    assert table_rows(U.orient(e, ids, roots, small=False)) == want


def test_what_reaches_the_driver_does_not_grow_with_the_layouts(spark, monkeypatch):
    r = random.Random(6)
    fields = [f"f{i:02}" for i in range(14)]
    layouts = [r.sample(fields, r.randint(2, 9)) for _ in range(400)]
    names = spark.createDataFrame(list(enumerate(layouts)), "file_id bigint, names array<string>")
    links = [(1, "renamed", a, b) for a, b in zip(fields, fields[1:])] + [(2, "renamed", "f00", "g00"), (3, "renamed", "g00", "f05")]
    changes = spark.createDataFrame(links, "file_id bigint, change string, old_field string, new_field string")
    got = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: (got.append(collect(df)), got[-1])[1])
    measure = drift.measure_names(changes, names)
    # All of f00 ... f13 stand side by side somewhere; g00 stands in no file and is linked to f00 first.
    assert measure == {n: n for n in fields} | {"g00": "f00"}
    assert max(len(x) for x in got) <= len(fields) + 2  # the lists of names side by side were hundreds of rows
