import itertools
import random

import pytest

from kinfold.functions.values import CATEGORIES
from kinfold.operators import network as nw
from tests.conftest import rows

PEOPLE = "id string, group_id string, female int, group_txt string, hh_id string"
TIES = "group_id string, i_id string, j_id string, type string"


def people(spark, data):
    return spark.createDataFrame(data, PEOPLE)


def ties(spark, data):
    return spark.createDataFrame(data, TIES)


def brute(persons, links, dedupe):
    """Dense pair table and compositions in plain Python."""
    count = {}
    for _, i, j, t in links:
        count[i, j, t] = 1 if dedupe else count.get((i, j, t), 0) + 1
    get = lambda i, j, t: count.get((i, j, t), 0)
    dense, comp = {}, {p[0]: dict.fromkeys(("lender_ij", "lender_ji", *CATEGORIES), 0) for p in persons}
    for a, b in itertools.permutations(persons, 2):
        if a[1] != b[1]:
            continue
        i, j = a[0], b[0]
        home = int(a[4] is not None and a[4] == b[4])
        kin = int(get(i, j, "family") + get(j, i, "family") + home > 0)
        row = (get(i, j, "lender"), get(j, i, "lender"), get(i, j, "friend"), kin)
        dense[i, j] = row, home
        comp[i]["lender_ij"] += row[0]
        comp[i]["lender_ji"] += row[1]
        lender, owed, friend, kin = row
        if lender == 1 and owed in (0, 1) and friend in (0, 1):
            # rows of CATEGORIES run friend, kin, both, neither, without and with debt
            place = {(1, 0): 0, (0, 1): 1, (1, 1): 2, (0, 0): 3}[friend, kin] + 4 * owed
            comp[i][CATEGORIES[place]] += 1
    return dense, comp


@pytest.fixture(scope="module")
def village():
    rng = random.Random(5)
    persons = [(f"p_{k}", f"g{k % 3}", rng.choice([0, 1, None]), "t", rng.choice(["h1", "h2", "h3", None])) for k in range(24)]
    persons.append(("alone", "g9", 1, "t", "h1"))
    ids = [p[0] for p in persons] + ["stranger"]
    links = [("g", rng.choice(ids), rng.choice(ids), rng.choice(["lender", "friend", "family", "geo"])) for _ in range(700)]
    return persons, links


@pytest.mark.parametrize("dedupe", [True, False])
def test_sparse_form_equals_dense_pairs(spark, village, dedupe):
    persons, links = village
    p, t = people(spark, persons), ties(spark, links)
    dense, comp = brute(persons, links, dedupe)
    d = nw.tied_dyads(t, p, dedupe).cache()
    found = {(r["i_id"], r["j_id"]): ((r["lender_ij"], r["lender_ji"], r["friend_ij"], r["family_ij"]), r["coresident"]) for r in d.collect()}
    assert all(dense[k] == v for k, v in found.items())
    untied = set(dense) - set(found)
    assert all(dense[k][0][:3] == (0, 0, 0) for k in untied)
    composed = nw.composition(d, p)
    got = {r["id"]: {c: r[c] for c in ("lender_ij", "lender_ji", *CATEGORIES)} for r in composed.collect()}
    assert got == comp
    total = {r["group_id"]: r for r in nw.dyad_totals(d, p).collect()}
    for g, r in total.items():
        mine = [v for (i, _), v in dense.items() if next(x[1] for x in persons if x[0] == i) == g]
        assert r["dyads"] == len(mine)
        assert r["family_ij"] == sum(v[0][3] for v in mine)
        assert r["lender_ij"] == sum(v[0][0] for v in mine)
        assert r["coresidents"] == sum(v[1] for v in mine)


def test_symmetries(spark, village):
    persons, links = village
    d = {(r["i_id"], r["j_id"]): r for r in nw.tied_dyads(ties(spark, links), people(spark, persons)).collect()}
    for (i, j), r in d.items():
        back = d[j, i]
        assert r["lender_ij"] == back["lender_ji"] and r["lender_ji"] == back["lender_ij"]
        assert r["family_ij"] == back["family_ij"]


def test_repeated_nomination_keeps_its_count(spark):
    p = people(spark, [("a", "g", 1, "t", None), ("b", "g", 0, "t", None)])
    t = ties(spark, [("g", "a", "b", "lender"), ("g", "a", "b", "lender")])
    raw = nw.composition(nw.tied_dyads(t, p, dedupe=False), p)
    assert rows(nw.composition_check(raw)) == {(2, 1)}
    assert rows(nw.taxonomy(nw.tied_dyads(t, p, dedupe=False)), "category") == {(None,)}
    assert rows(nw.composition_check(nw.composition(nw.tied_dyads(t, p, dedupe=True), p))) == {(2, 0)}


def test_counted_input_matches_long_input(spark):
    long = ties(spark, [("g", "a", "b", "lender")] * 3 + [("g", "a", "b", "family")])
    counted = spark.createDataFrame([("g", "a", "b", "lender", 3), ("g", "a", "b", "family", 1)], TIES + ", n long")
    for dedupe in (True, False):
        assert rows(nw.relation_counts(long, dedupe)) == rows(nw.relation_counts(counted, dedupe))


def test_only_pairs_of_one_group_count(spark):
    p = people(spark, [("a", "g", 1, "t", "h"), ("b", "g", 0, "t", "h"), ("c", "k", 0, "t", "h")])
    t = ties(spark, [("g", "a", "a", "lender"), ("g", "a", "c", "lender"), ("g", "a", "zz", "lender"), ("wrong", "a", "b", "lender")])
    assert rows(nw.tied_dyads(t, p), "i_id", "j_id", "lender_ij") == {("a", "b", 1), ("b", "a", 0)}


def test_ids_with_underscores_stay_apart(spark):
    p = people(spark, [(k, "g", 1, "t", None) for k in ("a_b", "c", "a", "b_c")])
    t = ties(spark, [("g", "a_b", "c", "lender")])
    d = nw.tied_dyads(t, p)
    assert rows(d, "i_id", "j_id") == {("a_b", "c"), ("c", "a_b")}
    keys = rows(nw.pair_keys(d))
    assert ("c", "a_b", "c_a_b", "a_b_c") in keys and ("a_b", "c", "a_b_c", "a_b_c") in keys


def test_pair_key_is_null_with_a_null_end(spark):
    kept = nw.kept_nominations(ties(spark, [("g", None, "b", "lender"), ("g", "a", "b", "geo")]))
    assert rows(kept, "ij_id") == {(None,)}


def test_missing_household_is_shared_with_nobody(spark):
    p = people(spark, [("a", "g", 1, "t", None), ("b", "g", 0, "t", None)])
    d = nw.tied_dyads(ties(spark, [("g", "a", "b", "lender")]), p)
    assert rows(d, "i_id", "coresident", "family_ij") == {("a", 0, 0), ("b", 0, 0)}


def test_exclusions_in_order(spark):
    p = people(spark, [("a", "g", 1, "t", None), ("b", "g", None, "t", None), ("c", "g", None, "t", None)])
    composed = nw.composition(nw.tied_dyads(ties(spark, [("g", "a", "b", "lender"), ("g", "b", "a", "lender")]), p), p)
    assert rows(nw.modelled(composed), "id") == {("a",)}
    assert rows(nw.exclusions(composed)) == {
        ("has_lender", True, 2), ("has_lender", False, 1), ("sex_missing", True, 1), ("sex_missing", False, 1)}


def test_histogram_is_zero_filled_to_the_union(spark):
    p = people(spark, [("a", "g", 1, "t", None), ("b", "g", 0, "t", None), ("c", "g", 0, "t", None)])
    t = ties(spark, [("g", "a", "b", "lender"), ("g", "a", "c", "lender")])
    h = {(r["category"], r["y"]): r["respondents"] for r in nw.count_histogram(nw.composition(nw.tied_dyads(t, p), p)).collect()}
    assert len(h) == 8 * 2
    assert h["stranger_lender_ij", 2] == 1 and h["stranger_lender_ij", 0] == 2 and h["family_lender_ij", 2] == 0


def test_nomination_shares_use_all_respondents(spark):
    p = people(spark, [(k, "g", 1, "t", None) for k in "abcd"])
    t = ties(spark, [("g", "a", "b", "lender"), ("g", "a", "c", "lender"), ("g", "b", "c", "family")])
    shares = rows(nw.nomination_shares(t, p), "type", "named", "share")
    assert shares == {("lender", 2, 0.25), ("lender", 0, 0.25), ("friend", 0, 0.5)}
    assert ("lender", 2, 0.1) in rows(nw.nomination_shares(t, p, n_respondents=10), "type", "named", "share")


def test_unknown_columns_are_rejected(spark):
    with pytest.raises(ValueError, match="j_id"):
        nw.kept_nominations(spark.createDataFrame([("a", "x")], "i_id string, type string"))


def test_no_plan_lists_pairs_of_a_group(spark, village, capsys):
    persons, links = village
    nw.composition(nw.tied_dyads(ties(spark, links), people(spark, persons)), people(spark, persons)).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
