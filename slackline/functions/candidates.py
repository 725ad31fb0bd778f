"""Candidate algebra as column expressions. Costs are BIGINT in scaled units (SCALE per unit)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000
#: Tile classes as they are stored in descriptors.
ALL_SKIP, ALL_SHORT, ALL_LONG, MIXED = "ALL_SKIP", "ALL_SHORT", "ALL_LONG", "MIXED"


def scaled(weight: Column) -> Column:
    """Whole units, rounded as decimals: a widened float would lose one unit now and then."""
    return F.round(weight.cast("double") * SCALE).cast("long")


def delta(src_dist: Column, dst_dist: Column, w: Column) -> Column:
    return dst_dist + w - src_dist


def candidate_cost(parent: Column, src_dist: Column, dst_dist: Column, w: Column) -> Column:
    return parent + delta(src_dist, dst_dist, w)


def parent_threshold(split: Column, dev_delta: Column) -> Column:
    """The largest parent cost whose candidate is at most ``split``."""
    return split - dev_delta


def reachable(src_dist: Column, dst_dist: Column) -> Column:
    return src_dist.isNotNull() & dst_dist.isNotNull()


def viable(dst: Column, succ: Column) -> Column:
    return ~dst.eqNullSafe(succ)


def pair_valid(src: Column, dst: Column, edge_id: Column) -> Column:
    return (src >= 0) & (dst >= 0) & (edge_id >= 0)


def bounded(use_final: Column, skip_long: Column) -> Column:
    return use_final | skip_long


def output_threshold(split: Column, final: Column, skip_long: Column) -> Column:
    return F.when(skip_long, split).otherwise(final)


def may_emit(min_parent: Column, src_dist: Column, dst_dist: Column, w: Column, split: Column, final: Column, use_final: Column, skip_long: Column) -> Column:
    """Whether the cheapest parent's candidate is within the threshold in force."""
    least = candidate_cost(min_parent, src_dist, dst_dist, w)
    return reachable(src_dist, dst_dist) & (~bounded(use_final, skip_long) | (least <= output_threshold(split, final, skip_long)))


def classify(cost: Column, split: Column, final: Column, use_final: Column, skip_long: Column) -> Column:
    return F.when(cost <= split, "SHORT").when(skip_long | (use_final & (cost > final)), "SKIP").otherwise("LONG")


def tile_class_of_counts(short: Column, long: Column, skip: Column, total: Column) -> Column:
    return F.when((total == 0) | (skip == total), ALL_SKIP).when(short == total, ALL_SHORT).when(long == total, ALL_LONG).otherwise(MIXED)


def tile_class_of_bounds(low: Column, high: Column, split: Column, final: Column, use_final: Column, skip_long: Column) -> Column:
    above = low > split
    return (
        F.when(high <= split, ALL_SHORT)
        .when(above & ~skip_long & (~use_final | (high <= final)), ALL_LONG)
        .when(above & (skip_long | (use_final & (low > final))), ALL_SKIP)
        .otherwise(MIXED)
    )


def tile_class_conservative(products: Column, reachable_devs: Column, devs: Column, bounds_class: Column) -> Column:
    """A uniform class that unreachable deviations make uncertain is MIXED."""
    partly = (reachable_devs < devs) & bounds_class.isin(ALL_SHORT, ALL_LONG)
    return F.when((products <= 0) | (reachable_devs <= 0), ALL_SKIP).when(partly, MIXED).otherwise(bounds_class)


def short_only_class(min_parent: Column, max_parent: Column, min_delta: Column, max_delta: Column, split: Column) -> Column:
    return F.when(max_parent + max_delta <= split, ALL_SHORT).when(min_parent + min_delta > split, ALL_SKIP).otherwise(MIXED)


def ceil_div(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), 0).otherwise(F.expr("0") + F.floor((a + b - 1) / b)).cast("long")


def tile_count(parents: Column, families: Column, m: Column, n: Column) -> Column:
    return ceil_div(parents, m) * ceil_div(families, n)


def tile_index(offset: Column, parent: Column, family: Column, families: Column, m: Column, n: Column) -> Column:
    bad = (offset < 0) | (parent < 0) | (family < 0) | (family >= families) | (m <= 0) | (n <= 0)
    return F.when(bad, -1).otherwise(offset + F.floor(parent / m) * ceil_div(families, n) + F.floor(family / n)).cast("long")


def chunk_size(left: Column, wanted: Column) -> Column:
    return F.when(left <= 0, 0).when(wanted <= 0, left).otherwise(F.least(left, wanted))


#: Numbers of the tile classes inside a descriptor word.
CLASS_CODE = {ALL_SKIP: 0, ALL_SHORT: 1, ALL_LONG: 2, MIXED: 3}


def pack_tile(parents: Column, families: Column, tile_class: Column) -> Column:
    code = F.coalesce(*(F.when(tile_class == name, F.lit(k)) for name, k in CLASS_CODE.items()))
    return (parents.bitwiseAND(255)).bitwiseOR(F.shiftleft(families.bitwiseAND(255), 8)).bitwiseOR(F.shiftleft(code, 16))


def unpack_tile(word: Column) -> Column:
    code = F.shiftright(word, 16).bitwiseAND(255)
    name = F.coalesce(*(F.when(code == k, F.lit(n)) for n, k in CLASS_CODE.items()))
    return F.struct(word.bitwiseAND(255).alias("parents"), F.shiftright(word, 8).bitwiseAND(255).alias("families"), name.alias("tile_class"))


def tile_is_valid(parent_base: Column, family_base: Column, slot: Column, sources: Column, word: Column) -> Column:
    t = unpack_tile(word)
    shape = t["parents"].between(1, 32) & t["families"].between(1, 16) & (t["tile_class"] != MIXED)
    return (parent_base >= 0) & (family_base >= 0) & slot.between(0, sources - 1) & shape


#: Why tiles are, or are not, worth it, in the order in which they are tried.
REASONS = ("no_products", "too_few_products", "low_tile_fill", "high_exact_fraction", "selected")


def dispatch(products: Column, exact: Column, capacity: Column, min_products: int = 1_000_000, min_fill: float = 0.5, max_exact: float = 0.05) -> Column:
    """struct(dispatch, reason, exact_fraction, tile_fill, rejected): whether tiles are worth it."""
    if not (0 <= min_fill <= 1 and 0 <= max_exact <= 1):
        raise ValueError("fractions lie between 0 and 1")
    fraction = F.when(products > 0, exact / products).otherwise(0.0)
    fill = F.when((products > 0) & (capacity > 0), products / capacity).otherwise(0.0)
    against = F.lit(len(REASONS) - 1)
    for k, test in reversed(list(enumerate((products == 0, products < min_products, fill < min_fill, fraction > max_exact)))):
        against = F.when(test, k).otherwise(against)
    reason = F.when(exact > products, F.raise_error(F.lit("more exact products than products"))).otherwise(F.element_at(F.array(*map(F.lit, REASONS)), against + 1))
    return F.struct((reason == REASONS[-1]).alias("dispatch"), reason.alias("reason"), fraction.alias("exact_fraction"), fill.alias("tile_fill"), F.when(products > 0, products - exact).otherwise(0).alias("rejected"))


def split_increment(average_degree: Column) -> Column:
    """A falling logistic curve of the average degree, from 100 down to 0.1."""
    return F.lit(0.1) + F.lit(99.9) / (1 + F.exp(F.lit(0.8) * (average_degree - 3)))
