"""Kinship, inbreeding, and mean kinship by generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import check_degree, registry
from ..plans.store import kept
from ..sources.pedigree import Pedigree
from .classes import BITS, MASK, Classes, alone, classes, met, size
from .reach import class_levels, contributions, depth, grows, lineage, lineage_of, unfolded


def threshold(min_kinship: float = 0.0, max_degree: int | None = None) -> float:
    """The stricter of both bounds: values at or below it are dropped on the way and not passed on."""
    return min_kinship if max_degree is None else max(min_kinship, 0.5 ** (check_degree(max_degree) + 1) - 1e-9)


def kinship(ped: Pedigree, min_kinship: float = 0.0, max_degree: int | None = None, derive_levels: bool = False) -> DataFrame:
    """(i, j, phi): both triangles and the diagonal, level by level of the supplied generation (derive_levels: of the depth instead).

    Identical twins share their genome from level 1 on. Supplied generations must grow along every link; others raise ValueError.
    Each level's part is written once; a level reads the parts before it and joins them with its own links alone. Without a threshold that is done for
    pairs of classes (childless full sibs as one), which unfold into individuals as they are read; a threshold may part sibs, so there every row is on its own.
    """
    bound = threshold(min_kinship, max_degree)
    cache = ped.__dict__.setdefault("_kinship", {})
    if (bound, derive_levels) not in cache:
        if not derive_levels and not grows(ped):
            raise ValueError("kinship needs generations that grow along every parent link")
        order = depth(ped).select("row", F.col("depth").alias("level")) if derive_levels else ped.people.select("row", F.col("generation").alias("level"))
        found = Classes(ped, apart=True) if bound > 0 else classes(ped)
        cache[bound, derive_levels] = _unfolded(found, _kinship_of_classes(ped, kept(order), found, bound))
    return cache[bound, derive_levels]


def _kinship_of_classes(ped: Pedigree, order: DataFrame, found: Classes | None = None, bound: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(lo, hi, phi) of different individuals of two classes or of one, in either order, each pair once; and (row, phi), an individual's with itself."""
    found = found or classes(ped)
    leads = found.edges.select(F.col("parent").alias("row")).distinct().withColumn("leads", F.lit(True))
    level = order.select(alone("row").alias("first"), "level")
    people = met(found.people.select("row", "m", "f", "tw", alone(F.shiftright("row", BITS)).alias("first")), level, "first").drop("first")
    people = kept(met(people, leads, "row", "left").withColumn("leads", F.coalesce("leads", F.lit(False))))
    links = kept(people.select(F.col("row").alias("child"), "level", F.col("leads").alias("li"), F.explode(F.array("m", "f")).alias("parent")).dropna())
    owns = [people.filter("m IS NULL AND f IS NULL").select("row", F.lit(0.5).alias("phi"), "leads")]
    # li, lj: who has children, and so is asked for by later levels.
    parts: list[DataFrame] = []
    for g in range(1, (order.agg(F.max("level")).first()[0] or 0) + 1):
        own = reduce(DataFrame.union, owns).filter("leads")
        kin = own.select(F.col("row").alias("parent"), F.col("row").alias("j"), "phi", F.lit(True).alias("lj"))
        for p in parts:
            kin = kin.union(p.filter("li").select(F.col("i").alias("parent"), "j", "phi", "lj")).union(p.filter("lj AND i <> j").select(F.col("j").alias("parent"), F.col("i").alias("j"), "phi", F.col("li").alias("lj")))
        here = links.filter(F.col("level") == g).drop("level")
        old = kept(met(here, kin, "parent").groupBy(F.col("child").alias("i"), "j", "li", "lj").agg((F.sum("phi") / 2).alias("phi")).filter(F.col("phi") > bound))
        low = old.select(F.col("i").alias("j"), F.col("j").alias("parent"), "phi", F.col("li").alias("lj"))
        new = met(low, here.withColumnRenamed("child", "i"), "parent").filter(f"j < i OR (j = i AND (i & {MASK}) > 1)").groupBy("i", "j", "li", "lj").agg((F.sum("phi") / 2).alias("phi")).filter(F.col("phi") > bound)
        bred = people.filter((F.col("level") == g) & F.expr("m IS NOT NULL OR f IS NOT NULL"))
        both = kin.select(F.col("parent").alias("m"), F.col("j").alias("f"), F.col("phi").alias("pphi"))
        own = kept(met(bred, both, ["m", "f"], "left").select("row", ((1 + F.coalesce("pphi", F.lit(0.0))) / 2).alias("phi"), "leads", "tw"))
        flags = people.select(F.col("row").alias("t"), F.col("leads").alias("lt"))
        twins = met(own.filter("tw IS NOT NULL").withColumnRenamed("tw", "t"), flags, "t")
        ends = F.greatest(F.struct("row", "leads"), F.struct(F.col("t").alias("row"), F.col("lt").alias("leads"))), F.least(F.struct("row", "leads"), F.struct(F.col("t").alias("row"), F.col("lt").alias("leads")))
        shared = twins.select(ends[0].alias("x"), ends[1].alias("y"), "phi", "row").select(F.col("x.row").alias("i"), F.col("y.row").alias("j"), F.col("x.leads").alias("li"), F.col("y.leads").alias("lj"), "phi", "row")
        shared = kept(shared.groupBy("i", "j", "li", "lj").agg(F.max_by("phi", "row").alias("phi")))
        parts += [old, kept(met(new, shared.select("i", "j"), ["i", "j"], "left_anti").union(shared))]
        owns.append(own.drop("tw"))
    pairs = reduce(DataFrame.union, parts).select(F.col("i").alias("lo"), F.col("j").alias("hi"), "phi") if parts else ped.spark.createDataFrame([], "lo long, hi long, phi double")
    return pairs, reduce(DataFrame.union, owns).select("row", "phi")


def _unfolded(found: Classes, table: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(i, j, phi) of individuals."""
    pairs, own = table
    listed = found.listed(pairs)
    ways = F.explode(F.array(F.struct(F.col("x").alias("i"), F.col("y").alias("j")), F.struct(F.col("y").alias("i"), F.col("x").alias("j"))))
    every = met(own, found.members, "row", "left").select(F.explode(F.coalesce("rows", F.array(F.shiftright("row", BITS)))).alias("i"), "phi")
    return listed.select(ways.alias("w"), "phi").select("w.i", "w.j", "phi").union(every.select("i", F.col("i").alias("j"), "phi"))


def inbreeding_of(people: DataFrame, lines: dict[int, DataFrame]) -> DataFrame:
    """(row, f, d): F = sum over ancestors of t * t * D, less 1, and each row's within-family variance D.

    people: row, m, f; lines: of lineage_of(). t, the genome share a row has of an ancestor, is a sum over paths. Each level is settled by a
    step that reads its own part of the lineage alone.
    """
    parts = [people.filter("m IS NULL AND f IS NULL").select("row", F.lit(0.0).alias("f"), F.lit(1.0).alias("d"))]
    both = F.col("pm").isNotNull() & F.col("pf").isNotNull()
    for line in lines.values():
        known = reduce(DataFrame.union, parts)
        fm, ff = known.select(F.col("row").alias("pm"), F.col("f").alias("fm")), known.select(F.col("row").alias("pf"), F.col("f").alias("ff"))
        one, two = 0.75 - F.coalesce("fm", "ff") / 4, 0.5 - (F.col("fm") + F.col("ff")) / 4
        above = met(line, known.select(F.col("row").alias("a"), "d"), "a").groupBy(F.col("i").alias("row")).agg(F.sum(F.col("t") * F.col("t") * F.col("d")).alias("s"))
        rows = met(people, above, "row").select("row", F.col("m").alias("pm"), F.col("f").alias("pf"), "s")
        rows = met(met(rows, fm, "pm", "left"), ff, "pf", "left").withColumn("d", F.when(both, two).otherwise(one))
        parts.append(kept(rows.select("row", F.when(both, F.col("s") + F.col("d") - 1).otherwise(0.0).alias("f"), "d")))
    return reduce(DataFrame.union, parts)


def inbreeding(ped: Pedigree) -> DataFrame:
    """(row, id, f): Wright's F; identical twins count as full sibs here."""
    if "_inbreeding" not in ped.__dict__:
        found = kept(inbreeding_of(classes(ped).people.select("row", "m", "f"), lineage(ped)).select("row", "f"))
        ped._inbreeding = kept(met(ped.people.select("row", "id"), unfolded(ped, found), "row"))
    return ped._inbreeding


def _members(ped: Pedigree) -> DataFrame:
    """(generation, n, twin_pairs), for each generation with members."""
    other = ped.people.select(F.col("row").alias("tw"), F.col("generation").alias("tg"))
    twins = met(ped.people.filter("tw > row"), other, "tw").filter("tg = generation").groupBy("generation").agg(F.count(F.lit(1)).alias("twin_pairs"))
    return ped.people.groupBy("generation").agg(F.count(F.lit(1)).alias("n")).join(twins, "generation", "left").select("generation", "n", F.coalesce("twin_pairs", F.lit(0)).alias("twin_pairs"))


def spine(ped: Pedigree) -> DataFrame:
    """(generation): 0 to the last."""
    return ped.spark.range(ped.last_generation + 1).select(F.col("id").cast("int").alias("generation"))


def _theta(ped: Pedigree, sums: DataFrame) -> DataFrame:
    pairs = F.expr("n * (n - 1) / 2 - twin_pairs")
    told = spine(ped).join(_members(ped), "generation", "left").join(sums, "generation", "left")
    return told.select("generation", F.when((F.col("n") >= 2) & (pairs > 0), F.coalesce("total", F.lit(0.0)) / pairs).alias("theta"))


def theta_per_generation(ped: Pedigree, min_kinship: float = 0.0) -> DataFrame:
    """(generation, theta): mean kinship over pairs of a generation, without twin pairs; null where there are none.

    Without a threshold, the sum over all pairs of a generation is half the sum over ancestors of D * (summed share) ** 2: no pair is ever listed.
    Identical twins of one family count as one genome there; other twin links and thresholds take the level-by-level kinship.
    """
    cache = ped.__dict__.setdefault("_theta", {})
    if min_kinship not in cache:
        cache[min_kinship] = kept(_theta(ped, _theta_by_pairs(ped, min_kinship) if min_kinship > 0 or not _plain_twins(ped) else _theta_by_shares(ped)))
    return cache[min_kinship]


def _theta_by_pairs(ped: Pedigree, min_kinship: float) -> DataFrame:
    return _pair_sums(ped, kinship(ped, min_kinship))


def _pair_sums(ped: Pedigree, table: DataFrame) -> DataFrame:
    people = ped.people.select("row", "generation", "tw")
    first, second = people.toDF("i", "generation", "tw"), people.select(F.col("row").alias("j"), F.col("generation").alias("gj"))
    pairs = met(met(table.filter("i < j"), first, "i"), second, "j").filter("generation = gj AND NOT (tw IS NOT NULL AND tw = j)")
    return pairs.groupBy("generation").agg(F.sum("phi").alias("total"))


def mean_kinship(ped: Pedigree, table: DataFrame) -> DataFrame:
    """(generation, theta) of a kinship table (i, j, phi) made before; pairs that it lacks count as 0."""
    return _theta(ped, _pair_sums(ped, table))


def _plain_twins(ped: Pedigree) -> bool:
    """All twin links mutual, within a generation, and (after generation 0) of the same parents."""
    other = ped.people.select(F.col("row").alias("tw"), F.col("tw").alias("back"), F.col("m").alias("m2"), F.col("f").alias("f2"), F.col("generation").alias("g2"))
    odd = met(ped.people.filter("tw IS NOT NULL"), other, "tw").filter("NOT (back <=> row AND generation = g2 AND (generation = 0 OR (m <=> m2 AND f <=> f2)))")
    return odd.limit(1).isEmpty()


def _genomes(ped: Pedigree) -> DataFrame:
    """(row, m, f, generation, rep) of classes: rep is the class itself, or of twins of one family the lower one."""
    rep = F.when(F.expr("generation > 0 AND tw < row AND (m IS NOT NULL OR f IS NOT NULL)"), F.col("tw")).otherwise(F.col("row"))
    return kept(classes(ped).people.select("row", "m", "f", "generation", rep.alias("rep")))


def _theta_by_shares(ped: Pedigree) -> DataFrame:
    people = _genomes(ped)
    reps = people.select("row", "rep")
    single = people.filter("row = rep")
    for side in ("m", "f"):
        single = met(single, reps.toDF(side, f"{side}r"), side, "left").drop(side).withColumnRenamed(f"{side}r", side)
    single = kept(single.select("row", "generation", "m", "f"))
    edges = kept(single.select(F.col("row").alias("child"), F.explode(F.array("m", "f")).alias("parent")).dropna())
    # Without twins to put together, the single genomes are the classes.
    plain = people.filter("row <> rep").limit(1).isEmpty()
    lines = lineage(ped) if plain else lineage_of(edges, met(class_levels(ped), single.select("row"), "row"))
    solved = kept(inbreeding_of(single.select("row", "m", "f"), lines))
    start = people.groupBy("generation", F.col("rep").alias("row")).agg(F.sum(size("row")).cast("double").alias("w"))
    w = contributions(ped, edges, start)
    # A class of several has no descendants: as many genomes of one share each.
    squared = F.when(size("row") > 1, F.col("w")).otherwise(F.col("w") * F.col("w"))
    whole = met(w, solved.select("row", "d"), "row").groupBy("generation").agg((F.sum(squared * F.col("d")) / 2).alias("all"))
    f = solved.select(F.col("row").alias("rep"), F.col("f").alias("inb"))
    own = met(people, f, "rep").groupBy("generation").agg(F.sum(size("row") * (1 + F.col("inb")) / 2).alias("own"), F.coalesce(F.sum(F.when(F.col("row") != F.col("rep"), 1 + F.col("inb"))), F.lit(0.0)).alias("twins"))
    return whole.join(own, "generation").select("generation", ((F.col("all") - F.col("own") - F.col("twins")) / 2).alias("total"))


def _asked(ped: Pedigree, pairs: DataFrame) -> DataFrame:
    """(lo, hi, phi) of asked pairs (lo, hi) of classes of several individuals (different ones of one class), by the recursion over just the pairs that those lead to.

    Twins of one family are one genome; the higher generation of a pair is replaced by its parents, one round for pairs of a generation and one
    for those with lower ones, and the rounds are then settled from the founders on.
    """
    people = _genomes(ped)
    reps = people.select("row", F.struct("generation", F.col("rep").alias("c")).alias("rep"))
    nodes = people.select("row", "m", "f")
    for side in ("m", "f"):
        nodes = met(nodes, reps.toDF(side, f"{side}r"), side, "left").drop(side).withColumnRenamed(f"{side}r", side)
    nodes = kept(nodes)  # row, and (generation, class) of its parents' genomes
    wanted = pairs.select("lo", "hi").distinct()
    for side in ("lo", "hi"):
        wanted = met(wanted, reps.toDF(side, f"{side}r"), side)
    # a: the later of both; step: the round.
    ordered = lambda df, x, y: df.select("*", F.greatest(x, y).alias("_x"), F.least(x, y).alias("_y")).select(
        *df.columns, F.col("_x.c").alias("a"), F.col("_y.c").alias("b"), (2 * F.col("_x.generation") + (F.col("_x.generation") == F.col("_y.generation")).cast("int")).alias("step"), F.col("_x.generation").alias("ga"), F.col("_y.generation").alias("gb"))
    asked = kept(ordered(wanted, "lor", "hir").drop("lor", "hir"))
    rounds = [asked.select("a", "b", "step", "ga", "gb")]
    single = F.expr(f"a = b AND (a & {MASK}) = 1")
    links: list[tuple[int, DataFrame, DataFrame]] = []
    for step in range(2 * ped.last_generation + 1, 1, -1):
        here = reduce(DataFrame.union, rounds).filter(F.col("step") == step).distinct()
        told = met(here, nodes.select(F.col("row").alias("a"), "m", "f"), "a")
        b = F.struct(F.col("gb").alias("generation"), F.col("b").alias("c"))
        # Of one genome with itself, its parents with each other; else each known parent with the other.
        ends = F.when(single, F.array(F.struct(F.col("m").alias("p"), F.col("f").alias("q")))).otherwise(F.array(F.struct(F.col("m").alias("p"), b.alias("q")), F.struct(F.col("f").alias("p"), b.alias("q"))))
        need = told.select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.explode(ends).alias("e")).filter("e.p IS NOT NULL AND e.q IS NOT NULL").select("a0", "b0", F.col("e.p").alias("p"), F.col("e.q").alias("q"))
        need = kept(ordered(need, "p", "q").drop("p", "q"))
        links.append((step, kept(here.select("a", "b")), need))
        rounds.append(need.select("a", "b", "step", "ga", "gb"))
    # Founders: one half with themselves, nothing with each other.
    first = reduce(DataFrame.union, rounds).filter("step < 2").select("a", "b").distinct()
    known = [kept(first.filter(single).select("a", "b", F.lit(0.5).alias("phi")))]
    for _, here, need in reversed(links):
        sums = met(need, reduce(DataFrame.union, known), ["a", "b"]).groupBy(F.col("a0").alias("a"), F.col("b0").alias("b")).agg((F.sum("phi") / 2).alias("s"))
        value = F.coalesce("s", F.lit(0.0))
        known.append(kept(met(here, sums, ["a", "b"], "left").select("a", "b", F.when(single, 0.5 + value).otherwise(value).alias("phi")).filter("phi > 0")))
    out = met(asked.select("lo", "hi", "a", "b"), reduce(DataFrame.union, known), ["a", "b"], "left")
    return out.select("lo", "hi", F.coalesce("phi", F.lit(0.0)).alias("phi"))


def _asked_or_known(ped: Pedigree, pairs: DataFrame) -> DataFrame:
    """(lo, hi, phi) of pairs of classes; irregular twin links take the whole table."""
    if not grows(ped):
        raise ValueError("kinship needs generations that grow along every parent link")
    if _plain_twins(ped):
        return _asked(ped, pairs)
    table, own = _kinship_of_classes(ped, kept(ped.people.select("row", F.col("generation").alias("level"))))
    every = table.union(table.filter("lo <> hi").select(F.col("hi").alias("lo"), F.col("lo").alias("hi"), "phi")).union(own.filter(size("row") == 1).select(F.col("row").alias("lo"), F.col("row").alias("hi"), "phi"))
    return met(pairs.select("lo", "hi").distinct(), every, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("phi", F.lit(0.0)).alias("phi"))


def pair_kinship(ped: Pedigree, pairs: DataFrame, exact: bool = False) -> DataFrame:
    """(code, idx1, idx2, phi) of pairs in the sample's rows (else the pedigree's).

    Where nobody is inbred and there are no twins, phi is the category's constant unless exact; else it follows from the kinship of just the pairs
    that the asked ones lead to, in classes of full sibs; 0 where unrelated. Pairs of extract_pairs() are looked up before they unfold.
    """
    whole = getattr(ped, "full", ped)  # a sample's pedigree shares what its full one keeps
    if not exact:
        bred = inbreeding(whole).agg(F.coalesce(F.max(F.abs("f") > 0), F.lit(False)).alias("bred")).first()["bred"]
        if not bred and ped.people.filter("tw IS NOT NULL").limit(1).isEmpty():
            return pairs.join(F.broadcast(registry(ped.spark).select("code", F.col("kinship").alias("phi"))), "code").select("code", "idx1", "idx2", "phi")
    if coded := getattr(pairs, "_coded", None):
        table, listed = coded
        table = kept(table)
        phi = kept(_asked_or_known(whole, table))
        return listed(met(table, phi, ["lo", "hi"]), "phi")
    graph = pairs.select("code", "idx1", "idx2", F.col("idx1").alias("i"), F.col("idx2").alias("j"))
    if ped.sample is not None:
        back = ped.sample.select("caller_row", "row")
        graph = met(met(pairs, back.toDF("idx1", "i"), "idx1"), back.toDF("idx2", "j"), "idx2")
    of = classes(whole).of_rows
    for row, cid in (("i", "lo"), ("j", "hi")):
        graph = met(graph, of.toDF(row, cid), row, "left").withColumn(cid, F.coalesce(cid, alone(row)))
    # An individual of a class of several with itself: its parents are asked for.
    itself = f"(i = j AND (lo & {MASK}) > 1)"
    parents = met(graph.filter(itself).drop("hi"), classes(whole).people.select(F.col("row").alias("lo"), "m", "f"), "lo")
    columns = ["code", "idx1", "idx2", "lo", "hi", "own"]
    graph = kept(graph.filter(f"NOT {itself}").withColumn("own", F.lit(False)).select(*columns).union(parents.select("code", "idx1", "idx2", "m", "f", F.lit(True))))
    told = met(graph, kept(_asked_or_known(whole, graph.dropna(subset=["lo", "hi"]))), ["lo", "hi"], "left").withColumn("phi", F.coalesce("phi", F.lit(0.0)))
    return told.select("code", "idx1", "idx2", F.when(F.col("own"), (1 + F.col("phi")) / 2).otherwise(F.col("phi")).alias("phi"))
