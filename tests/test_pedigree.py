"""The model: validation, id resolution, subsamples; hand-made pedigrees with known relationships."""

import json

import pytest

from kinforge.functions import registry as G
from kinforge.operators import cohort, counts, kinship, ne, pairs, reach, results
from kinforge.sources.pedigree import Pedigree

U = -1
# Small pedigrees with known answers, the same arrays as recorded in FIXTURES.md.
TINY = dict(mother=[U, U, U, U, 0, 0, 2, 2, 4, 5, 4], father=[U, U, U, U, 1, 1, 3, 3, 6, 7, 6], sex=[0, 1, 0, 1, 0, 0, 1, 1, 0, 0, 0], generation=[0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2])
INBRED = dict(mother=[U] * 6 + [0, 0, 0, 6, 3, 9, 10], father=[U] * 6 + [1, 1, 2, 7, 8, 4, 5], sex=[0, 1, 1, 0, 1, 1, 0, 1, 1, 0, 0, 0, 0], generation=[0] * 6 + [1, 1, 1, 2, 2, 3, 3])
SKIP = dict(mother=[U, U, U, U, 1, 1, 5, 3, 3, 7], father=[U, U, U, U, 0, 0, 4, 2, 6, 6], sex=[1, 0, 1, 0, 1, 0, 1, 0, 1, 0], generation=[0, 0, 0, 0, 1, 1, 2, 1, 3, 3])
INBRED_MZ = dict(mother=[U, U, 0, 0, 2, 2], father=[U, U, 1, 1, 3, 3], twin=[U, U, U, U, 5, 4], sex=[0, 1, 0, 1, 0, 0], generation=[0, 0, 1, 1, 2, 2])


def made(spark, **columns):
    n = len(columns["mother"])
    data = {"id": list(range(n)), "twin": [U] * n, "sex": [0] * n} | columns
    if "generation" not in data:
        return Pedigree.from_arrays(data["id"], data["mother"], data["father"], data["twin"], birth_year=data.get("birth_year"), sex=data["sex"], spark=spark)
    return Pedigree(data, spark)


def counted(df):
    return {r["code"]: r["n"] for r in df.collect() if r["n"]}


def found(ped, code, degree=5):
    return {(r["idx1"], r["idx2"]) for r in pairs.extract_pairs(ped, degree, codes=[code]).collect()}


def values(df, key="row", value="value"):
    return {r[key]: r[value] for r in df.collect()}


def test_registry():
    assert len(G.CODES) == 23 and G.PAIR_KINSHIP["1C"] == 1 / 16 and G.BY_CODE["2C"].degree == 5 and G.BY_CODE["MZ"].degree == 0 and G.BY_CODE["FS"].degree == 1
    assert {r.degree for r in G.REGISTRY if r.code in ("MHS", "GP", "Av")} == {2}
    with pytest.raises(ValueError, match="max_degree must be"):
        G.check_degree(6)


def test_tiny_all_engines(spark):
    ped = made(spark, **TINY)
    want = {"MO": 7, "FO": 7, "FS": 3, "GP": 12, "Av": 6, "1C": 2}
    assert counted(pairs.count_pairs(ped, 5)) == want
    assert found(ped, "Av") == {(5, 8), (5, 10), (4, 9), (7, 8), (7, 10), (6, 9)}
    assert found(ped, "1C") == {(8, 9), (9, 10)}
    assert counted(counts.count_pairs_scalar(ped, 5)) == want | {"1C": 4}
    with pytest.warns(FutureWarning):
        assert counted(counts.count_pairs_distinct(ped)) == want
    assert found(ped, "1C", 2) and not found(ped, "H1C", 3)


def test_inbred_rules_differ(spark):
    ped = made(spark, **INBRED)
    want = {"MO": 7, "FO": 7, "FS": 1, "MHS": 2, "GP": 8, "GGP": 4, "HAv": 3, "HGAv": 3, "H1C": 1, "1C1R": 2, "2C": 1}
    assert counted(pairs.count_pairs(ped, 5)) == want
    assert counted(counts.count_pairs_distinct(ped)) == {k: v for k, v in want.items() if k not in ("1C1R", "2C")} | {"H1C1R": 2}


def test_skip_generation(spark):
    ped = made(spark, **SKIP)
    assert counted(pairs.count_pairs(ped, 5)) == {"MO": 6, "FO": 6, "FS": 1, "MHS": 1, "PHS": 1, "GP": 8, "GGP": 4, "HAv": 1}
    assert counted(counts.count_pairs_scalar(ped, 5)) == {"MO": 6, "FO": 6, "FS": 1, "MHS": 1, "PHS": 1, "GP": 8, "GGP": 4, "Av": 2, "HAv": 1, "GAv": 4, "1C": 1, "1C1R": 2, "2C": 6}
    assert [r["ne"] for r in ne.sex_ratio_series(ped).orderBy("generation").collect()][:2] == [4, pytest.approx(8 / 3)]


def test_kinship_of_inbred_twins(spark):
    ped = made(spark, **INBRED_MZ)
    k = {(r["i"], r["j"]): r["phi"] for r in kinship.kinship(ped).collect()}
    assert k[4, 5] == k[4, 4] == k[5, 5] == 0.625 and k[2, 4] == k[3, 5] == 0.375
    assert values(kinship.inbreeding(ped), value="f") == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0.25, 5: 0.25}
    sub = Pedigree.from_subsample({"id": list(range(6)), **INBRED_MZ}, {"id": [5, 4]}, spark)
    got = kinship.pair_kinship(sub, pairs.extract_pairs(sub, 0)).collect()
    assert [(r["code"], r["idx1"], r["idx2"], r["phi"]) for r in got if r["code"] == "MZ"] == [("MZ", 0, 1, 0.625)]
    theta = values(kinship.theta_per_generation(ped), "generation", "theta")
    assert theta[0] == 0 and theta[1] == 0.25 and theta[2] is None


@pytest.mark.parametrize("mother, father, row, f", [([U, U, 0, 0, 2], [U, U, 1, 1, 3], 4, 0.25), ([U, 0], [U, 0], 1, 0.5), ([U, U, 0, 0], [U, U, 1, 2], 3, 0.25), ([U, U, U, 0, 0, 3], [U, U, U, 1, 2, 4], 5, 0.125)])
def test_inbreeding(spark, mother, father, row, f):
    assert values(kinship.inbreeding(made(spark, mother=mother, father=father)), value="f")[row] == f


def test_twins_children(spark):
    ped = made(spark, mother=[U, U, 0, 0, 2], father=[U, U, 1, 1, 3], twin=[U, U, 3, 2, U], generation=[0, 0, 1, 1, 2])
    assert values(kinship.inbreeding(ped), value="f")[4] == 0.25
    assert {(r["i"], r["j"]): r["phi"] for r in kinship.kinship(ped).collect()}[4, 4] == 0.75


def test_plan_records():
    assert len(G.REL_PLAN) == 23 and G.REL_PLAN["2C"] == G.EngineSupport(False, True) and G.REL_PLAN["FS"].streaming_exact
    assert G.streaming_exact_codes() | G.streaming_approximate_codes() == set(G.CODES) and not G.streaming_exact_codes() & G.streaming_approximate_codes()
    assert G.bfs_divergent_codes() == {c for c, p in G.REL_PLAN.items() if p.bfs_diverges_under_inbreeding} and len(G.bfs_divergent_codes()) == 4


def test_flat_generations(spark):
    """Supplied generations that don't grow: refused, unless levels are to be derived."""
    flat = made(spark, mother=[U, U, 0, 0, 2], father=[U, U, 1, 1, 3], generation=[0] * 5)
    with pytest.raises(ValueError, match="grow"):
        kinship.kinship(flat)
    k = {(r["i"], r["j"]): r["phi"] for r in kinship.kinship(flat, derive_levels=True).collect()}
    assert k[4, 4] == 0.625 and k[2, 3] == 0.25 and values(kinship.inbreeding(flat), value="f")[4] == 0.25


def test_too_many_paths(spark):
    """Selfing doubles the paths at each step; beyond 64 bits the query says so."""
    n = 70
    ped = made(spark, mother=[U, *range(n - 1)], father=[U, *range(n - 1)], generation=list(range(n)))
    with pytest.raises(Exception, match="exceeds 64 bits"):
        reach.n_descendants(ped).collect()
    assert values(reach.n_ancestors(made(spark, mother=[U, 0, 1], father=[U, 0, 1], generation=[0, 1, 2]))) == {0: 0, 1: 1, 2: 2}


def test_threshold(spark):
    ped = made(spark, mother=[U, 0, 1, 2], father=[U] * 4, generation=[0, 1, 2, 3])
    k = {(r["i"], r["j"]): r["phi"] for r in kinship.kinship(ped, max_degree=2).collect()}
    assert k[0, 1] == 0.25 and k[0, 2] == 0.125 and (0, 3) not in k


def test_lineage(spark):
    ped = Pedigree.from_arrays([0, 1, 2, 5, 3, 6, 4], [U, U, 0, U, 2, U, 3], [U, U, 1, U, 5, U, 6], spark=spark)
    assert {r["id"]: r["value"] for r in reach.n_ancestors(ped).collect() if r["value"]} == {2: 2, 3: 4, 4: 6}
    assert {r["id"]: r["value"] for r in reach.n_descendants(ped).collect()} == {0: 3, 1: 3, 2: 2, 5: 2, 3: 1, 6: 1, 4: 0}
    assert values(made(spark, mother=[U, 0, 1], father=[U] * 3).people, value="generation") == {0: 0, 1: 1, 2: 2}


def test_validation(spark):
    good = dict(mother=[U, U], father=[U, U], twin=[U, U], sex=[0, 1], generation=[0, 0])
    for ids, message in (([0, 0], "duplicate id"), ([-1, 0], "nonnegative"), ([0.0, 1.0], "integer")):
        with pytest.raises(ValueError, match=message):
            Pedigree({"id": ids, **good}, spark)
    with pytest.raises(ValueError, match="length"):
        Pedigree({"id": [0, 1], **good, "mother": [U]}, spark)
    with pytest.raises(ValueError, match="mother"):
        Pedigree({"id": [0, 1]}, spark)
    with pytest.raises(ValueError, match="topological order"):
        made(spark, mother=[U, U, 0, 5, U, U], father=[U] * 6, generation=[0] * 6)
    trio = dict(mother=[U, U, 0], father=[U, U, 1], generation=[0, 0, 1])
    with pytest.raises(ValueError, match="father-child"):
        made(spark, birth_year=[1990, 2010, 1995], **trio)
    known = made(spark, birth_year=[1990.0, float("nan"), 2010.0], **trio)
    assert values(known.people, value="birth_year") == {0: 1990, 1: None, 2: 2010}
    with pytest.raises(ValueError, match="scope must be"):
        pairs.count_pairs(known, scope="bogus")
    sparse = Pedigree.from_arrays([0, 1, 2000000000, 2000000001], [U, U, 0, 0], [U, U, 1, 1], spark=spark)
    assert values(sparse.people, value="m") == {0: None, 1: None, 2: 0, 3: 0}


def test_subsample(spark):
    full = {"id": [0, 2, 1, 3, 4], "mother": [U, U, 0, 0, 1], "father": [U, U, 2, 2, 3], "twin": [U] * 5, "sex": [0] * 5, "generation": [0, 0, 1, 1, 2]}
    sub = Pedigree.from_subsample(full, {"id": [1, 3, 4]}, spark)
    assert all(max(r["idx1"], r["idx2"]) < 3 for r in pairs.extract_pairs(sub, 2).collect())
    whole, part = counted(pairs.count_pairs(sub, 2, "full")), counted(pairs.count_pairs(sub, 2))
    assert all(whole[c] >= n for c, n in part.items()) and part["FS"] == 1
    with pytest.raises(ValueError, match="not present in full_pedigree"):
        Pedigree.from_subsample(full, {"id": [99]}, spark)
    with pytest.raises(NotImplementedError, match="from_subsample"):
        counts.count_pairs_scalar(sub, 2, "subsample")


def test_cohorts(spark):
    ped = made(spark, mother=[U, U, 0], father=[U, U, 1], birth_year=[1990, 1992, 2010], sex=[0, 1, 0], generation=[0, 0, 1])
    assert cohort.generation_interval_record(ped) == (19, 18, 20, 2)
    window = cohort.eligible_cohort_range(ped)
    assert (window.c_min, window.c_max) == (1990, 1990) and window.reproductive_age_p95 == pytest.approx(19.9)
    with pytest.raises(ValueError):
        cohort.eligible_cohort_range(made(spark, mother=[U], father=[U], generation=[0]))


def test_closed_line(spark):
    mother, father, sex = [U, U], [U, U], [1, 0]
    for g in range(1, 6):
        mother += [2 * g - 1] * 2
        father += [2 * g - 2] * 2
        sex += [1, 0]
    ped = made(spark, mother=mother, father=father, sex=sex, generation=[i // 2 for i in range(12)])
    f = [r["mean_f"] for r in ne.mean_f(ped).orderBy("generation").collect()]
    assert f == [0, 0, 0.25, 0.375, 0.5, 0.59375]
    c = [r["mean_self_coancestry"] for r in ne.caballero_toro_series(ped).orderBy("generation").collect()]
    assert c[0] is None and c[1:] == [0.5, 0.625, 0.6875, 0.75, 0.796875]
    long = ne.ne_long_term_contributions(ped)
    assert (long.ne, long.n_iterations, long.sum_c_squared) == (1, 1, 0.5)
    every = ne.compute_all_ne(ped)
    assert len(every) == 8 and every["ne_hill_overlapping"].collapses_to_ne_v
    assert every["ne_inbreeding"].mean_f_per_gen == f and every["ne_caballero_toro"].n_founders_with_descendants_per_gen[1:] == [2] * 5
    for r in every.values():
        assert json.loads(json.dumps(r.to_dict()))["ne"] == r.ne
    # What was made before is taken instead of made again.
    k = kinship.kinship(ped)
    by_k, by_theta = ne.ne_coancestry(ped, K=k), ne.ne_coancestry(ped, theta_per_gen=kinship.theta_per_generation(ped))
    assert by_k.mean_theta_per_gen == pytest.approx(by_theta.mean_theta_per_gen, nan_ok=True) and by_k.ne == pytest.approx(every["ne_coancestry"].ne)
    assert ne.ne_long_term_contributions(ped, mean_contributions=ne.founder_means(ped)) == every["ne_long_term_contributions"]
    assert ne.ne_caballero_toro(ped, ct_accumulators=ne.caballero_toro_accumulators(ped)) == every["ne_caballero_toro"]
    skipped = ne.compute_all_ne(ped, skip_ne_coancestry=True)["ne_coancestry"]
    assert skipped == results.NeCoancestryResult.empty(5) and skipped.to_dict()["mean_theta_per_gen"] == [None] * 6
    assert ped.release() > 5 and not [x for x in ped.__dict__ if x.startswith("_")]
    assert [r["mean_f"] for r in ne.mean_f(ped).orderBy("generation").collect()] == f


def test_hill(spark):
    base = dict(sex=[1, 1, 0, 0, 1, 1, 0, 0], generation=[0] * 4 + [1] * 4, birth_year=[1900] * 4 + [1910] * 4)
    balanced = made(spark, father=[U] * 4 + [0, 1, 0, 1], mother=[U] * 4 + [2, 3, 2, 3], **base)
    assert ne.ne_hill_overlapping(balanced).ne == pytest.approx(80)
    skewed = made(spark, father=[U] * 4 + [0] * 4, mother=[U] * 4 + [2] * 4, **base)
    r = ne.ne_hill_overlapping(skewed)
    assert r.ne == pytest.approx(16) and r.Vk_m_per_cohort[0] == 8 and r.cohort_years[0] == 1900
    assert r.to_dict()["age_table"] == {"ages_m": [10], "offspring_count_m": [4], "ages_f": [10], "offspring_count_f": [4]} and r.cohort_window.c_min == 1900 and r.n_offspring_pairs == 8
    with pytest.warns(RuntimeWarning):
        assert ne.ne_sex_ratio(made(spark, father=[U, U, 1], mother=[U, U, 0], generation=[0, 0, 1])).ne is None


def test_overlapping_generations_rules(spark):
    mother = [U, U, U, U, U, 1, 4, 2, 1, 3, 7, 4, 11, 10, 5]
    father = [U, U, U, U, U, 3, U, U, 6, 6, 8, 7, 1, 3, 2]
    ped = made(spark, mother=mother, father=father)
    exact, distinct = counted(pairs.count_pairs(ped, 5)), counted(counts.count_pairs_distinct(ped))
    assert (exact.get("1C1R", 0), exact.get("H1C1R", 0)) == (0, 2) and (distinct["1C1R"], distinct["H1C1R"]) == (1, 1)
    same = lambda d: {c: n for c, n in d.items() if c not in ("1C1R", "H1C1R")}
    assert same(exact) == same(distinct)


def test_second_cousins(spark):
    mother = [U, U, 0, 0, U, U, 4, 5, U, U, 8, 9, U, U, U, 12, 12, U, U, 17, 18, U, U, 21, 22]
    father = [U, U, 1, 1, U, U, 2, 3, U, U, 6, 7, U, U, U, 13, 14, U, U, 15, 16, U, U, 19, 20]
    gens = [0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3]
    ped = made(spark, mother=mother, father=father, generation=gens)
    assert found(ped, "2C") == {(10, 11)}
    want = {"MO": 12, "FO": 12, "FS": 1, "MHS": 1, "GP": 16, "Av": 2, "GGP": 8, "HAv": 2, "GAv": 2, "1C": 1, "HGAv": 2, "H1C": 1, "1C1R": 2, "H1C1R": 2, "2C": 1}
    assert counted(pairs.count_pairs(ped, 5)) == want


# Two sisters 2 and 3 with 12 childless children each (by 4 and 5), of which 6 has one child of its own; rows 31 and 32 are twins.
SIBSHIPS = dict(mother=[U, U, 0, 0, U, U, *[2] * 12, *[3] * 12, 6, 2, 2], father=[U, U, 1, 1, U, U, *[4] * 12, *[5] * 12, U, 4, 4], twin=[U] * 31 + [32, 31], generation=[0, 0, 1, 1, 1, 1, *[2] * 24, 3, 2, 2])


def test_sibships_are_one_class(spark):
    ped = made(spark, **SIBSHIPS)
    got = counted(pairs.count_pairs(ped, 5))
    assert {c: got[c] for c in ("MZ", "FS", "1C", "Av", "1C1R")} == {"MZ": 1, "FS": 133, "1C": 14 * 12, "Av": 12 + 14 + 11, "1C1R": 12 + 2}
    rows = pairs.extract_pairs(ped, 5).collect()
    assert len(set(rows)) == len(rows) == sum(got.values())
    assert found(ped, "1C") == {(min(i, j), max(i, j)) for i in [*range(6, 18), 31, 32] for j in range(18, 30)} and found(ped, "Av") >= {(7, 30), (17, 30), (3, 6), (2, 18)}
    # Pairs are made once for a class, and no table that grows with the input goes through the driver.
    own = pairs.rules(ped)
    assert own.pairs("FS").count() == 4 and own.pairs("1C").count() == 4
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Broadcast" not in own.classes.listed(own.coded(["FS", "1C"]))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sub = Pedigree.from_subsample(ped, {"id": [30, 20, 19, 8, 7, 6]}, spark)
    assert {(r["code"], r["idx1"], r["idx2"]) for r in pairs.extract_pairs(sub, 2).collect()} == {("MO", 0, 5), ("FS", 1, 2), ("FS", 3, 4), ("FS", 3, 5), ("FS", 4, 5), ("Av", 0, 3), ("Av", 0, 4), *(("1C", i, j) for i in (1, 2) for j in (3, 4, 5))}
    assert counted(pairs.count_pairs(sub, 2)) == {"MO": 1, "FS": 4, "Av": 2, "1C": 6}


def test_sibs_that_share_an_ancestor_at_two_depths(spark):
    """Full sibs 5, 6 and 7 have 0 as grandmother and as great-grandmother: two of one class meet there in both directions."""
    ped = made(spark, mother=[U, U, 0, 2, 0, 4, 4, 4], father=[U, U, 1, U, U, 3, 3, 3])
    assert pairs.rules(ped).shared(2, 3).filter("lo = hi").select("n").collect() == [(1,)]
    distinct = counts.DistinctRules(ped)
    assert distinct.shared(2, 3).filter("lo = hi").select("n").collect() == [(2,)]


def _by_rows(ped, bound=0.0):
    """(i, j, phi) by the definition, a pair at a time: the kinship of the later row's parents with the other one; what is not above the bound is dropped at once."""
    people = {r["row"]: r for r in ped.people.collect()}
    k, last = {}, max(r["generation"] for r in people.values())
    parents = lambda i: [p for p in (people[i]["m"], people[i]["f"]) if p is not None]
    for g in range(last + 1):
        here = sorted(i for i, r in people.items() if r["generation"] == g)
        before = [j for j, r in people.items() if r["generation"] < g]
        own = {i: (1 + k.get((people[i]["m"], people[i]["f"]), 0)) / 2 for i in here}
        level = {}
        for i in here:
            for j in before + [j for j in here if j < i]:
                through = k if j in before else level
                if (phi := sum(through.get((j, p) if through is level else (p, j), 0) for p in parents(i)) / 2) > bound:
                    level[i, j] = level[j, i] = phi
        k |= level | {(i, i): own[i] for i in here}
        for i in here:
            if people[i]["tw"] is not None and parents(i):
                k[i, people[i]["tw"]] = k[people[i]["tw"], i] = own[i]
    return ped.spark.createDataFrame([(i, j, float(phi)) for (i, j), phi in k.items()], "i long, j long, phi double")


def test_kinship_of_classes(spark):
    """The table of classes unfolds into the one that takes every row on its own: sibships, inbreeding, twins with children, a link that skips levels."""
    ped = made(spark, **SIBSHIPS)
    rows = lambda df: sorted(tuple(r) for r in df.select("i", "j", "phi").collect())
    assert rows(kinship.kinship(ped)) == rows(_by_rows(ped))
    table = kinship._kinship_of_classes(ped, ped.people.select("row", ped.people["generation"].alias("level")))
    assert table[0].count() < 70 < 400 < len(rows(kinship.kinship(ped)))
    # 4 and 5 are twins with a child each, 6 and 7; 8 to 10 are inbred sibs of 6 and 7; 11 is of 8 and founder 0.
    bred = made(spark, mother=[U, U, 0, 0, 2, 2, 4, 0, 6, 6, 6, 0], father=[U, U, 1, 1, 3, 3, U, 5, 7, 7, 7, 8], twin=[U, U, U, U, 5, 4, *[U] * 6], generation=[0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5])
    assert rows(kinship.kinship(bred)) == rows(_by_rows(bred))
    # A threshold may part sibs: rows stay apart, and only those with children are joined with the next level's links.
    assert rows(kinship.kinship(bred, max_degree=2)) == rows(_by_rows(bred, kinship.threshold(max_degree=2)))


def test_pair_kinship_asks_for_its_pairs_alone(spark):
    """Every pair looked up through the recursion is the whole table's, and extract_pairs' own pairs are looked up as classes."""
    irregular = dict(mother=[U, U, 0, 0, 2, 2, 2], father=[U, U, 1, 1, 3, 3, 3], twin=[U, U, U, U, 5, U, U], generation=[0, 0, 1, 1, 2, 2, 2])
    twins = dict(mother=[U, U, 0, 0, 2, 2, 4, 0, 6, 6, 6, 0], father=[U, U, 1, 1, 3, 3, U, 5, 7, 7, 7, 8], twin=[U, U, U, U, 5, 4, *[U] * 6], generation=[0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5])
    for columns in (twins, irregular):
        ped = made(spark, **columns)
        table = {(r["i"], r["j"]): r["phi"] for r in _by_rows(ped).collect()}
        n = len(columns["mother"])
        every = spark.createDataFrame([("x", i, j) for i in range(n) for j in range(n)], "code string, idx1 long, idx2 long")
        assert {(r["idx1"], r["idx2"]): r["phi"] for r in kinship.pair_kinship(ped, every).collect()} == {(i, j): table.get((i, j), 0) for i in range(n) for j in range(n)}
    ped = made(spark, **SIBSHIPS)
    listed = pairs.extract_pairs(ped, 2)
    got = kinship.pair_kinship(ped, listed).collect()
    assert "_kinship" not in ped.__dict__ and len(got) == listed.count() and {r["phi"] for r in got if r["code"] == "1C"} == {0.0625} and {r["phi"] for r in got if r["code"] == "MZ"} == {0.5}


def test_lineage_and_mean_kinship_of_classes(spark):
    """A sibship's ancestors are made once; sums by generation weigh it by its members; joins of whole tables are merged."""
    ped = made(spark, **SIBSHIPS)
    assert sum(t.count() for t in reach.lineage(ped).values()) < 35
    assert {i: n for i, n in values(reach.n_ancestors(ped)).items() if n} == {2: 2, 3: 2, 30: 5, **dict.fromkeys([*range(6, 30), 31, 32], 4)}
    theta, by_pairs = values(kinship.theta_per_generation(ped), "generation", "theta"), values(kinship.mean_kinship(ped, _by_rows(ped)), "generation", "theta")
    assert theta == pytest.approx(by_pairs)
    bred = made(spark, mother=[U, U, 0, 0, *[2] * 5], father=[U, U, 1, 1, *[3] * 5], generation=[0, 0, 1, 1, *[2] * 5])
    assert values(kinship.inbreeding(bred), value="f") == dict.fromkeys(range(4), 0) | dict.fromkeys(range(4, 9), 0.25)
    assert values(kinship.theta_per_generation(bred), "generation", "theta") == {0: 0, 1: 0.25, 2: 0.375}
    assert {(r["generation"], r["founder"], r["sums"], r["n"]) for r in ne.caballero_toro_accumulators(bred).collect()} == {(g, a, s, n) for a in (0, 1) for g, s, n in ((0, 0.5, 1), (1, 1, 2), (2, 3.125, 5))}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (reach.eqg(ped), reach.n_ancestors(ped), kinship._asked(ped, pairs.rules(ped).coded(["FS"]))):
            assert "Broadcast" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
