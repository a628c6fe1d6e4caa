"""One-to-one titles in rounds equal the sequential fold."""

import difflib
import random

import pytest

from brindle.operators import tables as T
from brindle.plans.registry import QUERIES
from brindle.session import table

SF = "/root/testdata/sf0.001"


def fold(wanted, have, least):
    """wanted, have: (project, id, core)."""
    out = []
    for p in {x[0] for x in wanted}:
        spellings = {}
        for _, i, t in sorted(x for x in have if x[0] == p and len(x[2]) >= 3):
            spellings.setdefault(t, []).append(i)
        order = {t: ids[0] for t, ids in spellings.items()}
        for _, i, t in sorted(x for x in wanted if x[0] == p and len(x[2]) >= 3):
            scores = sorted((-round(difflib.SequenceMatcher(None, t, s).ratio(), 6), order[s], s) for s, ids in spellings.items() if ids)
            if scores and -scores[0][0] >= least:
                out.append((p, i, spellings[scores[0][2]].pop(0), -scores[0][0]))
    return sorted(out)


@pytest.mark.parametrize("least", [0.55, 0.8])
def test_random_titles(spark, least):
    rng = random.Random(4)
    title = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 7)))
    wanted = [(f"p{k % 3}", k, title()) for k in range(150)]
    have = [(f"p{k % 3}", k, title()) for k in range(120)] + [("p0", 1000 + k, "abcab") for k in range(8)]
    wanted += [("p0", 2000 + k, "abcab") for k in range(15)]
    a = spark.createDataFrame(wanted, "project_id string, wanted_id int, title string")
    b = spark.createDataFrame(have, "project_id string, have_id int, title string")
    want = fold(wanted, have, least)
    assert sorted(map(tuple, T.matched_titles(a, b, least=least).collect())) == want and len(want) > 30


def test_titles_of_the_tables(spark):
    p = table(spark, SF, "part").toPandas()
    core = lambda t: "".join(t.split())
    wanted = [(r.p_brand, r.p_partkey, core(r.p_name)) for r in p.itertuples()]
    have = [(r.p_brand, r.p_partkey, core(r.p_name + r.p_type)) for r in p.itertuples()]
    assert sorted(map(tuple, QUERIES["titles_one_to_one"](spark, SF).collect())) == fold(wanted, have, 0.55)


def test_nothing(spark):
    a = spark.createDataFrame([("p", 1, None), ("p", 2, "ab"), (None, 3, "abcdef")], "project_id string, wanted_id int, title string")
    b = spark.createDataFrame([("p", 1, "abc")], "project_id string, have_id int, title string")
    assert T.matched_titles(a, b).collect() == [] and T.matched_titles(a.limit(0), b.limit(0)).collect() == []
