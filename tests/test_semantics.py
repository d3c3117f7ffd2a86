"""Missing values, ties, identifiers and bins on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from umbral.functions import scalars as S
from umbral.functions import text as X
from umbral.functions.geometry import clean_datum, impute_zone
from umbral.operators import aggregates as A
from umbral.operators import chartdata as K
from umbral.operators import columns as C
from umbral.operators import filters as W
from umbral.operators import joins as J
from umbral.operators import ranking as R
from umbral.operators import samples as P
from umbral.sources.tables import read_folder_union


def values(df, *exprs):
    return [tuple(r) for r in df.select(*exprs).collect()]


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_identifiers(spark):
    rows = [("123-45",), ("123/45.6",), ("123",), ("-12-3",), (None,), ("12ñ-4",)]
    df = spark.createDataFrame(rows, "rol string")
    got = values(df, X.normalise_id("rol"), X.extra_part_flag("rol"))
    assert got == [("123-45", 0), ("123-45", 1), ("123-NA", 0), ("-12", 1), ("NA-NA", 0), ("12ñ-4", 0)]


@pytest.mark.parametrize(
    "a,b,want",
    [("ab", "ab", 0), ("ab", "ba", 1), ("abc", "acb", 1), ("abc", "ab", 1), ("abc", "xbc", 1), ("a", "b", 1), ("", "a", 1),
     ("", "", 0), ("abcd", "badc", None), ("abc", "cba", None), (None, "a", None), ("a", "xyz", None), ("ca", "abc", None)],
)
def test_edit_distance(spark, a, b, want):
    assert one(spark, [(a, b)], "a string, b string", X.dl_0_1("a", "b")) == [want]


@pytest.mark.parametrize("a,b", [("ab", "ba"), ("abc", "ab"), ("abc", "xbc"), ("a", "b"), ("", "a"), ("abcd", "abdc"), ("aab", "ab")])
def test_near_names_share_a_key(spark, a, b):
    got = one(spark, [(a, b)], "a string, b string", F.arrays_overlap(X.one_deletion_keys("a"), X.one_deletion_keys("b")))
    assert got == [True]


def test_accents(spark):
    assert one(spark, [("Ñuñoa",), ("Concepción",), ("Æsir Øre",), (None,)], "c string", X.normalise_name("c")) == [
        "nunoa", "concepcion", "aesir ore", None]


def test_paste_and_digits(spark):
    assert one(spark, [(None, "b")], "a string, b string", X.paste("a", "b", sep="-")) == ["NA-b"]
    assert one(spark, [("2011-2",), ("n 7",), ("x",)], "a string", X.digits_prefix("a")) == [2011.0, None, None]


def test_datum_rules(spark):
    rows = [("WGS 84",), ("wgs84",), ("PSAD 56",), ("Psad56",), ("SAD-69",), ("69",), ("otro",), (None,)]
    assert one(spark, rows, "d string", clean_datum("d")) == ["WGS84", "WGS84", "SAD69", "SAD69", "SAD69", "SAD69", None, None]
    assert one(spark, rows, "d string", clean_datum("d", strict=True)) == ["WGS84", "WGS84", "PSAD56", "PSAD56", "SAD69", "SAD69", None, None]
    zones = [(None, 6.5e5, 5.5e6), (None, 6.5e5, 4e6), (None, None, 5.5e6), (18, 1.0, 1.0), (20, 1.0, 1.0)]
    assert one(spark, zones, "z int, x double, y double", impute_zone("z", "x", "y")) == [18, 19, 19, 18, 20]


def test_missing_keys_match(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (4, "r")], "k int, v string")
    assert sorted(values(J.join_inner(a, b, ["k"]), "k", "v_x", "v_y"), key=str) == [(1, "x", "p"), (None, "y", "q")]
    assert values(J.join_inner(a, b, ["k"], na_matches=False), "k") == [(1,)]
    full = sorted(values(J.join_full(a, b, ["k"]), "k", "v_x", "v_y"), key=str)
    assert full == [(1, "x", "p"), (3, "z", None), (4, None, "r"), (None, "y", "q")]
    assert values(J.join_anti(a, b, ["k"]), "k") == [(3,)]
    assert len(values(W.in_column(a, "k", b), "k")) == 2
    right = J.join_right(a, b, ["k"])
    assert right.columns == ["v_x", "k", "v_y"] or set(right.columns) == {"k", "v_x", "v_y"}
    assert right.count() == 3


def test_missing_rank_drops_the_group(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", None, 2), ("b", 2.0, 3), ("b", 1.0, 4)], "g string, d double, id int")
    assert values(R.best_per_group(df, ["g"], [F.col("d")], ["id"]), "g", "id") == [("b", 4)]
    skip = R.best_per_group(df, ["g"], [F.col("d")], ["id"], null_policy="skip")
    assert sorted(values(skip, "g", "id")) == [("a", 1), ("b", 4)]


def test_strict_mean_and_shares(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, v double")
    assert sorted(values(A.group_mean(df, ["g"], ["v"], strict=True), "g", "v"), key=str) == [("a", None), ("b", 2.0)]
    assert sorted(values(A.group_mean(df, ["g"], ["v"]), "g", "v")) == [("a", 1.0), ("b", 2.0)]
    assert values(A.distinct_ratio(df.where("g = 'a'"), df, "g"), "rate") == [(0.5,)]
    assert values(A.range_agg(df, ["v"]), "min_v", "max_v") == [(1.0, 2.0)]


def test_bins(spark):
    rows = [(0.0,), (5.0,), (5.1,), (500.0,), (500.1,), (None,)]
    assert one(spark, rows, "x double", S.bin_edges("x", 0, 500, 5)) == [None, 1, 2, 100, None, None]
    rows = [(0.0,), (1.0,), (10.0,), (None,)]
    assert one(spark, rows, "x double", S.bin_count("x", 10, F.lit(0.0), F.lit(10.0))) == [1, 1, 10, None]
    assert one(spark, [(3.0,)], "x double", S.bin_count("x", 10, F.lit(3.0), F.lit(3.0))) == [1]


def test_flags(spark):
    assert one(spark, [("Si",), ("No",), (None,)], "c string", S.flag_not_no("c")) == [1, 0, 0]
    assert one(spark, [("a",), ("b",), (None,)], "c string", S.flag_equal("c", "a")) == [1, 0, None]
    assert one(spark, [(20.0,), (200.0,), (-10.0,), (15.5,), (None,)], "c double", S.round_heap("c")) == [1, 0, 1, 0, None]
    assert one(spark, [(11,), (5,), (99,), (None,)], "r int", S.region_cutoff("r")) == [800, 200, 500, 500]
    marks = [(1.645,), (1.96,), (2.58,), (-3.0,), (1.0,)]
    assert one(spark, marks, "z double", S.stars("z", F.lit(1.0))) == ["*", "*", "**", "***", ""]
    assert one(spark, [(1.0, 0.0)], "a double, b double", S.ratio("a", "b")) == [None]


def test_samples(spark):
    df = spark.createDataFrame([(1, 1, True), (2, 0, True), (3, None, False)], "id int, received_bonus int, Awarded boolean")
    got = sorted(values(P.sample_groups(df), "data_group", "id"))
    assert got == [("All enrollees", 1), ("All enrollees", 2), ("All enrollees", 3), ("Never received bonus", 2),
                   ("Never received bonus", 3), ("Received bonus", 1), ("Received bonus", 3)]
    rows = [("Other interested", 2013, "x"), ("Other interested", 2014, "x"), ("Smallholder", 2014, "Segundo c"), ("Smallholder", 2014, None)]
    df = spark.createDataFrame(rows, "t string, y int, n string")
    assert [r[0] for r in values(df, P.in_contest("t", "y", "n"))] == [True, False, True, False]
    sized = spark.createDataFrame([(250.0, 200, "Smallholder", 199.0), (250.0, 200, "Other interested", 240.0), (None, 200, "Smallholder", 1.0),
                                   (None, 200, "Other interested", 1.0)], "polyarea double, size_cutoff int, `Contest type` string, propertysize_reported double")
    assert P.censor_sample(sized).count() == 2
    assert P.censor_sample(sized, drop_over=False, max_gap=30).count() == 1


def test_spec_curve_layout(spark):
    df = spark.createDataFrame([(i, float(-i), 1.0, True, None) for i in range(1, 8)], "spec_seq int, estimate double, se double, a boolean, b boolean")
    out = K.spec_curve(df, {"P": ["a", "b"]}, group_size=3, highlight=F.col("spec_seq") == 2).orderBy("x")
    assert values(out, "x", "a", "b")[:4] == [(1, "yes", "missing"), (2, "highlighted", "missing"), (3, "yes", "missing"), (5, "yes", "missing")]
    assert [r[0] for r in values(out, "x")] == [1, 2, 3, 5, 6, 7, 9]
    uneven = K.spec_curve(df, {"P": ["a"]}, group_size=[2, 5], order="increasing").orderBy("x")
    assert [r[0] for r in values(uneven, "x")] == [1, 2, 4, 5, 6, 7, 8]
    assert values(uneven, "spec_seq")[0] == (7,)
    with pytest.raises(TypeError):
        K.spec_curve(df.withColumn("estimate", F.lit("x")), {})
    assert K.label_rows({"M": ["a", "b"], "B": ["c"]}) == [("M", "a", 2, 1), ("M", "b", 3, 1), ("B", "c", 5, 4)]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "Trees_2000 int, `Grassland/Ag` double, water_2000 double")
    assert C.select_matching(df, ["2000"]).columns == ["Trees_2000", "water_2000"]
    assert C.across_ratio(df, ["Grassland/Ag"], "Trees_2000").columns[-1] == "pct_Grassland/Ag"
    assert C.fill_zero(df).first()["water_2000"] == 0
    assert C.pivot_flags(df.withColumn("m", F.lit("a")), "m", ["a", "b"]).select("a", "b").first() == (True, False)


def test_folder_union_of_different_files(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, x string").write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([(2, 3.0)], "id int, y double").write.parquet(str(tmp_path / "two"))
    df = read_folder_union(spark, [str(tmp_path / "one"), str(tmp_path / "two")], source_col="file")
    assert sorted(values(df, "id", "x", "y")) == [(1, "a", None), (2, None, 3.0)]
    assert df.where("file LIKE '%/one/%'").count() == 1


def test_lookups_get_whole_tables(spark, monkeypatch):
    """Rows that must not match reach the operators with a key that misses."""
    from umbral.operators import linkage as L
    from umbral.plans import linkage, relational
    from umbral.plans.registry import Tables

    t, seen = Tables(spark, "/root/testdata/sf0.001"), []

    def spy(module, name, *at):
        real = getattr(module, name)

        def run(*args, **named):
            seen.extend(args[i].count() for i in at)
            return real(*args, **named)

        monkeypatch.setattr(module, name, run)

    spy(W, "in_column", 2)
    spy(L, "build_activity_flags", 1, 2)
    relational.in_column(t)
    linkage.build_activity_flags(t)
    assert seen == [t.customer.count(), t.lineitem.count(), t.events.count()]
    seen.clear()
    spy(J, "join_inner", 1)
    spy(J, "join_anti", 1)
    relational.join_null_safe(t)
    relational.join_anti_variants(t)
    assert seen == [t.customer.count()] * 2
    seen.clear()
    spy(J, "join_left", 1)
    relational.activity_flags(t)
    users = t.events.select(F.when(F.col("value") > 100, F.col("user_id")).otherwise(-1 - F.col("user_id")), "event_type")
    assert seen == [users.distinct().count()]


def test_match_by_id_drops_unknown_identifiers_first(spark, monkeypatch):
    """Applications that no boundary can match are not written, and the others match as before."""
    from umbral.operators import linkage

    apps = spark.createDataFrame(
        [(1, "5-1", "ab", 4.0), (2, "8-1", "ab", 4.0), (3, "5-1", "zzz", 4.0), (4, None, "ab", 2.0), (5, "6-1", "ab", 4.0)],
        "prop_id int, rol string, comuna string, size_ha double",
    )
    cad = spark.createDataFrame(
        [("5-1", 1, "abc", 3.0, 1, 1), ("5-1", 2, "ab", 6.0, 1, 0), (None, 3, "ab", 2.5, 1, 0), ("6-1", 4, "qqq", 4.0, 1, 0), ("9-1", 5, "zzz", 4.0, 1, 0)],
        "ROL string, poly_id int, desccomu string, polyarea double, rol_prty_ciren int, src_prty int",
    )
    written = []
    monkeypatch.setattr(linkage, "materialise", lambda df: written.append(df) or df)
    out = linkage.match_by_id(apps, cad)
    # a missing identifier is an identifier, and its normal form is NA-NA
    assert {(r.prop_id, r.ROL, r.poly_id) for r in out.collect()} == {(1, "5-1", 2), (4, None, 3)}
    (probes,) = [df for df in written if "prop_id" in df.columns]
    assert {r.prop_id for r in probes.collect()} == {1, 4}


def test_missing_keys_are_spread(spark):
    """Rows of the left frame that miss a key meet in many tasks, and match as in a plain left join."""
    from umbral.operators.joins import join_left, join_left_spread

    left = spark.createDataFrame([(i, None if i % 4 else i, "k") for i in range(800)] + [(3, None, "k")] * 2, "id int, a int, b string")
    right = spark.createDataFrame([(None, "k", "x"), (None, "k", "y"), (8, "k", "z"), (None, None, "w")], "a int, b string, v string")
    on = ["a", "b"]
    assert sorted(map(str, join_left_spread(left, right, on).collect())) == sorted(map(str, join_left(left, right, on).collect()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = join_left_spread(left, right, on).where("a is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(out) > 4 and max(r["count"] for r in out) < 600


def test_activity_flags_of_missing_stands(spark):
    """A property without stands meets the activities without a stand, one without an id the stands without one."""
    from umbral.operators.linkage import build_activity_flags

    table = spark.createDataFrame([(1, 2010, 10), (1, 2010, 11), (2, 2010, None), (3, None, 12)], "rptpro_id int, rptpro_ano int, rptpre_id int")
    stands = spark.createDataFrame([(10, 5), (None, 6)], "rptpre_id int, rptro_id int")
    acts = spark.createDataFrame([(5, "a"), (6, "b"), (None, "c"), (7, "a")], "rptro_id int, rptac_tipo string")
    out = build_activity_flags(table, stands, acts, ("a", "b", "c"))
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(1, 2010, 1, 0, 1), (2, 2010, 0, 1, 0), (3, None, 0, 0, 1)]
