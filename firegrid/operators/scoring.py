"""Rules that turn measures into flags and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firegrid.operators.prefix import running_sums


def seed_threshold(raw: Column, *floors: Column) -> Column:
    return F.greatest(raw, *floors)


def grow_threshold(seed: Column, delta: Column, floor: Column) -> tuple[Column, Column]:
    """The growth threshold and whether it was clamped to the seed's."""
    free = F.greatest(seed - delta, floor)
    return F.least(free, seed), free > seed


def class3(pct: Column, bad: float, good: float, low_confidence: Column) -> Column:
    """bad beats good; low confidence beats both."""
    return F.when(low_confidence, "ambiguous").when(pct <= bad, "bad_identified").when(pct >= good, "good_identified").otherwise("ambiguous")


def ecdf(values: DataFrame, pool: DataFrame, value: str) -> DataFrame:
    """values with pct, the share of pool's values not above their own, from running counts of distinct values."""
    marks = values.select(value).distinct().withColumn("n", F.lit(0).cast("long")).unionByName(pool.groupBy(value).agg(F.count("*").alias("n"))).groupBy(value).agg(F.sum("n").alias("n"))
    placed = running_sums(marks, [], value, {"upto": "n"})
    share = F.try_divide(F.col("upto"), F.col("all"))  # an empty pool gives null
    whole = pool.agg(F.count(value).alias("all"))  # one row
    return values.join(placed.crossJoin(F.broadcast(whole)).select(value, share.alias("pct")), value)


def merge_labels(internal: Column, external: Column, ranks: dict[str, int]) -> Column:
    """The label of the better (lower) rank; an empty or unknown one loses; two unknown ones give the internal one."""
    rank = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[c], F.lit(1 << 20))
    a, b = F.nullif(internal, F.lit("")), F.nullif(external, F.lit(""))
    return F.when(a.isNull(), b).when(b.isNull(), a).when(rank(b) < rank(a), b).otherwise(a)


def support_flag(hit: Column, na_frac: Column, most_na: float, burnable: Column) -> Column:
    return F.when(hit, "keep").when(na_frac > most_na, "drop_corine_na").when(burnable, "review").otherwise("drop_unburnable")


#: Words that carry no name in an administrative unit's name.
STOP_WORDS = ["comunidad", "comunitat", "autonoma", "region", "principado", "foral", "de", "del", "la", "las", "los", "el", "y"]


def admin_key(name: Column) -> Column:
    """Accents folded, lower case, `&` as y, other signs as spaces, stop words dropped, joined."""
    plain = F.translate(F.lower(name), "áàäâãéèëêíìïîóòöôõúùüûñç", "aaaaaeeeeiiiiooooouuuunc")
    words = F.split(F.regexp_replace(F.regexp_replace(plain, "&", " y "), "[^a-z0-9]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS)), "")


def harmonized_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; missing columns become null, columns of different types strings."""
    kinds = dict(b.dtypes)
    clash = [c for c, t in a.dtypes if kinds.get(c, t) != t]
    return a.withColumns({c: a[c].cast("string") for c in clash}).unionByName(b.withColumns({c: b[c].cast("string") for c in clash}), allowMissingColumns=True)
