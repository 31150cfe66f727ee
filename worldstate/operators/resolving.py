"""Names resolved to known entities, by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quotes

#: Characters by which names and the names in them meet; shorter names meet whole.
GRAM = 64


def _pieces(s: Column, lengths: Column) -> Column:
    """Every stretch of s of one of these lengths, once; the empty one, too."""
    of = lambda k: F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: s.substr(i, k))
    every = F.transform(F.filter(lengths, lambda k: (k > 0) & (k <= F.length(s))), of)
    return F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(every)))


def _lengths(names: DataFrame, name: str) -> DataFrame:
    """The lengths, up to GRAM, at which names can be met: one row of GRAM + 1 numbers at most."""
    return F.broadcast(names.agg(F.collect_set(F.least(F.length(name), F.lit(GRAM))).alias("_lengths")))


def resolve(asked: DataFrame, entities: DataFrame, name: str = "name", within: tuple[str, ...] = ()) -> DataFrame:
    """Rows of asked with entity_id and leg: exact (a name or alias is the same), part (one name holds the other), or null.

    entities: id, name, aliases (array), place (their order) and the columns `within` which both sides must agree on, a tenant
    say. Of several entities of a leg the first by place and id is taken. Names are alike in normal form (quotes.normal). Null and empty
    names, and those of a null tenant, are nobody's; one of white space alone is part of every name. An entity without
    a name can only be met by an alias.

    No pair is tried that has nothing in common: an entity's first GRAM characters meet those stretches of the names asked, and the
    other way round, by stretches of those lengths alone that the other side has. What is shorter than that meets whole and needs no
    look at the names, so for every stretch only its first entity is kept before the join. Each different name is resolved once.
    """
    names = asked.select(*within, name).where(F.col(name) != "").distinct().withColumn("_n", quotes.normal_form(F.col(name)))
    keys = names.select(*within, "_n").distinct()
    known = entities.select(*within, F.struct("place", "id").alias("_e"), F.col("name").alias("_name"), "aliases")
    none = F.array().cast("array<string>")
    spelled = known.select(*within, "_e", F.explode(F.array_compact(F.concat(F.array("_name"), F.coalesce("aliases", none)))).alias("_s"))
    first = F.min("_e").alias("_e")
    exact = spelled.withColumn("_n", quotes.normal_form(F.col("_s"))).groupBy(*within, "_n").agg(first)
    named = known.withColumn("_en", quotes.normal_form(F.col("_name"))).where("_en <> ''").groupBy(*within, "_en").agg(first)

    begins = named.withColumn("_g", F.left("_en", F.lit(GRAM)))
    pieces = lambda df, x, others, y: df.crossJoin(_lengths(others, y)).withColumn("_g", F.explode(_pieces(F.col(x), F.col("_lengths")))).drop("_lengths")
    holding = pieces(keys, "_n", named, "_en").join(begins, [*within, "_g"]).where((F.length("_en") <= GRAM) | F.contains("_n", "_en"))
    stretches = pieces(named, "_en", keys, "_n")
    short = keys.where(F.length("_n") <= GRAM).join(stretches.groupBy(*within, F.col("_g").alias("_n")).agg(first), [*within, "_n"])
    long = keys.where(F.length("_n") > GRAM).withColumn("_g", F.left("_n", F.lit(GRAM))).join(stretches.where(F.length("_g") == GRAM), [*within, "_g"]).where(F.contains("_en", "_n"))
    part = holding.select(*within, "_n", "_e").unionByName(short.select(*within, "_n", "_e")).unionByName(long.select(*within, "_n", "_e")).groupBy(*within, "_n").agg(first)

    found = exact.withColumn("_leg", F.lit(0)).unionByName(part.withColumn("_leg", F.lit(1))).groupBy(*within, "_n").agg(F.min(F.struct("_leg", "_e")).alias("_best"))
    best = names.join(found, [*within, "_n"]).select(*within, name, F.col("_best._e.id").alias("entity_id"), F.when(F.col("_best._leg") == 0, "exact").otherwise("part").alias("leg"))
    return asked.join(best, [*within, name], "left").select(*asked.columns, "entity_id", "leg")
