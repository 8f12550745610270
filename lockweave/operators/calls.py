"""Type hierarchy and call resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockweave.plans.loop import grow

#: Call sites with more possible targets keep their declared body only.
POLYMORPHIC = 4


def supertypes(edges: DataFrame) -> DataFrame:
    """sub, sup: the transitive closure of direct supertypes; names without a class stay as leaves."""
    up = edges.select("sub", "sup")
    return grow(up, lambda d: d.withColumnRenamed("sup", "mid").join(up.withColumnsRenamed({"sub": "mid"}), "mid").select("sub", "sup"), name="supertypes")


def reflexive(closure: DataFrame, classes: DataFrame) -> DataFrame:
    return closure.union(classes.select(F.col("class").alias("sub"), F.col("class").alias("sup"))).distinct()


def namesig_index(methods: DataFrame) -> DataFrame:
    """namesig, keys: sorted method keys that define it."""
    return methods.groupBy("namesig").agg(F.array_sort(F.collect_set("mkey")).alias("keys"))


def exact(sites: DataFrame, methods: DataFrame, type_col: str) -> DataFrame:
    """site, target: the body that the named type itself defines; no walk up the hierarchy."""
    own = methods.select(F.col("class").alias(type_col), "namesig", F.col("mkey").alias("target"))
    return sites.join(own, [type_col, "namesig"]).select("site", "target")


def bodies(pairs: DataFrame, methods: DataFrame, below: DataFrame, instantiated: DataFrame) -> DataFrame:
    """declared, namesig, target: bodies of instantiated subtypes of the declared type, other than the declared body.

    Bodies meet their class's supertypes before any pair: a row a body and supertype, not one a subtype and name called.
    """
    live = methods.join(instantiated.select("class").distinct(), "class", "left_semi").select("class", "namesig", F.col("mkey").alias("target"))
    subs = below.select(F.col("sup").alias("declared"), F.col("sub").alias("class")).where("declared <> class")
    return live.join(subs, "class").join(pairs.select("declared", "namesig").distinct(), ["declared", "namesig"], "left_semi").select("declared", "namesig", "target").distinct()


def candidates(sites: DataFrame, methods: DataFrame, below: DataFrame, instantiated: DataFrame, most: int | None = None) -> DataFrame:
    """site, target: the ``bodies`` of each site's declared type; with ``most``, of sites that have no more.

    Sites that agree in declared type and name share their bodies, which are counted
    and cut before any site is joined.
    """
    each = bodies(sites, methods, below, instantiated)
    if most is not None:
        few = each.groupBy("declared", "namesig").agg(F.count("*").alias("n")).where(F.col("n") <= most).drop("n")
        each = each.join(few, ["declared", "namesig"])
    return sites.select("site", "declared", "namesig").join(each, ["declared", "namesig"]).select("site", "target").distinct()


def candidate_counts(sites: DataFrame, methods: DataFrame, below: DataFrame, instantiated: DataFrame) -> DataFrame:
    """site, n: how many ``candidates`` each site has, if any, without a row a site and candidate.

    Sites with the same pairs of declared type and name (one pair, unless rows share a
    site) have the same candidates, which are counted once.
    """
    of = sites.where("declared is not null and namesig is not null").groupBy("site").agg(F.array_sort(F.collect_set(F.struct("declared", "namesig"))).alias("pairs"))
    each = of.select("pairs").distinct().select("pairs", F.explode("pairs").alias("p")).select("pairs", "p.declared", "p.namesig")
    n = each.join(bodies(sites, methods, below, instantiated), ["declared", "namesig"]).groupBy("pairs").agg(F.count_distinct("target").alias("n"))
    return of.join(n, "pairs").select("site", "n")


def dispatch(sites: DataFrame, methods: DataFrame, below: DataFrame, instantiated: DataFrame, most: int = POLYMORPHIC) -> DataFrame:
    """site, target, how.

    ``sites``: site, virtual, declared, receiver (null if unknown), namesig.  Exact
    receivers that define the method settle a call; else the candidates of a virtual
    call, unless there are more than ``most``, and the declared body.
    """
    known = exact(sites.where("virtual and receiver is not null"), methods, "receiver").withColumn("how", F.lit("receiver"))
    rest = sites.join(known.select("site"), "site", "left_anti")
    few = candidates(rest.where("virtual"), methods, below, instantiated, most).withColumn("how", F.lit("candidate"))
    own = exact(rest, methods, "declared").withColumn("how", F.lit("declared"))
    return known.union(few).union(own)


def hit(entry: Column, cls: Column, name: Column) -> Column:
    """A configuration entry names a call bare, by the class's last name, or in full."""
    return (entry == name) | (entry == F.concat_ws(".", F.substring_index(cls, ".", -1), name)) | (entry == F.concat_ws(".", cls, name))


def deferring(sites: DataFrame, below: DataFrame, bases: DataFrame, veto: DataFrame) -> DataFrame:
    """site of the calls that a supertype's base table defers, less vetoed names.

    ``sites``: site, declared, name; ``bases``: base, name; ``veto``: entry.
    """
    ups = below.select(F.col("sub").alias("declared"), F.col("sup").alias("base")).union(sites.select("declared", F.col("declared").alias("base"))).distinct()
    found = sites.join(ups, "declared").join(F.broadcast(bases), ["base", "name"]).select("site", "declared", "name").distinct()
    return found.join(F.broadcast(veto), hit(F.col("entry"), F.col("declared"), F.col("name")), "left_anti").select("site")
