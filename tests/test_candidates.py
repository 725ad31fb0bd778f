"""Boundary cases of the candidate algebra."""

from pyspark.sql import functions as F

from slackline.functions import candidates as C


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_classes(spark):
    def of(cost, skip=False):
        return value(spark, C.classify(F.lit(cost), F.lit(10000), F.lit(20000), F.lit(True), F.lit(skip)))

    assert [of(10000), of(15000), of(20000), of(21000), of(15000, True)] == ["SHORT", "LONG", "LONG", "SKIP", "SKIP"]


def test_tiles(spark):
    L = F.lit
    got = [value(spark, C.tile_class_of_counts(L(a), L(b), L(c), L(d))) for a, b, c, d in ((4, 0, 0, 4), (0, 4, 0, 4), (0, 0, 4, 4), (1, 3, 0, 4), (0, 0, 0, 0))]
    assert got == ["ALL_SHORT", "ALL_LONG", "ALL_SKIP", "MIXED", "ALL_SKIP"]
    assert value(spark, C.tile_count(L(120), L(173), L(32), L(16))) == 44
    assert value(spark, C.tile_index(L(5), L(33), L(17), L(16), L(32), L(16))) == -1
    word = C.pack_tile(L(32), L(16), L("ALL_LONG"))
    assert tuple(value(spark, C.unpack_tile(word))) == (32, 16, "ALL_LONG")
    assert value(spark, C.tile_is_valid(L(0), L(0), L(1), L(2), word)) is True


def test_scaling_and_dispatch(spark):
    assert [value(spark, C.scaled(F.lit(x))) for x in (2.3, 0.45, 8.2, 11.2, 0.22)] == [23000, 4500, 82000, 112000, 2200]
    assert value(spark, C.dispatch(F.lit(2_000_000), F.lit(10), F.lit(3_000_000)))["reason"] == "selected"
    assert value(spark, C.dispatch(F.lit(10), F.lit(1), F.lit(20)))["reason"] == "too_few_products"
    assert value(spark, C.viable(F.lit(3), F.lit(None).cast("int"))) is True
