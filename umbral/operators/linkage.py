"""Linking applications to property boundaries by identifier, place name and coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbral.functions.scalars import col, flag_equal, flag_not_no, ratio, region_cutoff
from umbral.functions.text import dl_0_1, extra_part_flag, normalise_id, normalise_name, one_deletion_keys, split_id
from umbral.operators.aggregates import indicator_any
from umbral.operators.joins import join_anti, join_full, join_inner, join_left, join_left_spread, join_semi
from umbral.operators.ordering import nearest_by_key
from umbral.operators.ranking import best_per_group, filter_group_extreme, first_per_key
from umbral.session import materialise


def id_variants(df: DataFrame, raw: str, name: str = "ROL", priority: str = "rol_prty") -> DataFrame:
    """Each row twice: raw identifier (priority 1) and normalised one (priority 0), from one scan."""
    pair = F.array(
        F.struct(col(raw).cast("string").alias("id"), F.lit(1).alias("p")),
        F.struct(normalise_id(raw).alias("id"), F.lit(0).alias("p")),
    )
    out = df.withColumn("_v", F.explode(pair))
    return out.select(
        *[col(c) for c in df.columns if c not in {raw, name, priority}],
        F.col("_v.id").alias(name),
        F.col("_v.p").alias(priority),
    )


def cadastre_union(sources: Sequence[tuple[DataFrame, str, int]], place: str = "desccomu", raw: str = "rol") -> DataFrame:
    """Boundary sources ``(frame, name, priority)`` as one layer with identifier variants and plain place names."""
    out = None
    for df, label, priority in sources:
        part = id_variants(df, raw, "ROL", "rol_prty_ciren").withColumns(
            {"source": F.lit(label), "src_prty": F.lit(priority), place: normalise_name(place)}
        )
        out = part if out is None else out.unionByName(part)
    return out


def near_names(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct normalised names within edit distance 1, with the distance.

    Works on distinct names and joins them on shared one-deletion keys.
    """
    la = left.select(col(a).alias("a_name")).where(col(a).isNotNull()).distinct()
    rb = right.select(col(b).alias("b_name")).where(col(b).isNotNull()).distinct()
    ka = la.withColumn("_k", F.explode(one_deletion_keys("a_name")))
    kb = rb.withColumn("_k", F.explode(one_deletion_keys("b_name")))
    pairs = ka.join(kb, "_k").select("a_name", "b_name").distinct()
    return pairs.withColumn("name_dist", dl_0_1("a_name", "b_name")).where(F.col("name_dist").isNotNull())


def match_by_id(
    apps: DataFrame,
    cad: DataFrame,
    raw_id: str = "rol",
    place: str = "comuna",
    size: str = "size_ha",
    prop: str = "prop_id",
    cad_place: str = "desccomu",
    cad_area: str = "polyarea",
    payload: Sequence[str] = ("poly_id",),
    ties: Sequence[str] = ("poly_id",),
    **bucket_args,
) -> DataFrame:
    """Best boundary per (property, identifier, place): least name distance, least area difference,
    best source, best identifier priority, then ``ties``.

    Applications and boundaries that share an identifier are never paired off: the boundaries are
    reduced to one row per (identifier, place, area), and each application looks up only the nearest
    area below and above its own size (:func:`nearest_by_key`). Applications whose identifier and place no boundary
    has are dropped first. A missing area or size makes the difference missing and drops the group, as the
    strict minimum demands. Both sides are read several times, so they are written to the shared folder first.
    """
    best = F.min(F.struct((-F.col("src_prty")).alias("s"), (-F.col("rol_prty_ciren")).alias("r"),
                          *[col(p).alias(p) for p in payload])).alias("_b")
    targets = cad.groupBy("ROL", col(cad_place).alias("b_name"), col(cad_area).alias("_v")).agg(best)
    targets = targets.select("ROL", "b_name", "_v", (-F.col("_b.s")).alias("src_prty"),
                             (-F.col("_b.r")).alias("rol_prty_ciren"), *[F.col("_b").getField(p).alias(p) for p in payload])
    targets = materialise(targets)

    # most identifiers are in no boundary source: left out before rows are multiplied by near names, and again after
    named = id_variants(apps, raw_id, "ROL", "rol_prty").withColumn("_name", normalise_name(place))
    pairs = near_names(named, cad, "_name", cad_place)
    by_key = targets.select("ROL", "b_name").hint("merge")  # compresses to little, but is large in a broadcast
    known = join_semi(named, by_key, ["ROL"])
    probes = known.join(pairs, known["_name"] == pairs["a_name"]).drop("_name", "a_name")
    probes = materialise(join_semi(probes, by_key, ["ROL", "b_name"]))
    found_cols = ["src_prty", "rol_prty_ciren", *payload]

    sized = probes.where(col(size).isNotNull()).select("ROL", "b_name", col(size).cast("double").alias("_v")).distinct()
    near = nearest_by_key(sized, targets.where(F.col("_v").isNotNull()), ["ROL", "b_name"], "_v", found_cols, **bucket_args)
    with_size = join_inner(
        probes.withColumn("_v", col(size).cast("double")), near.hint("merge"), ["ROL", "b_name", "_v"]
    ).withColumnRenamed("target_value", cad_area).drop("_v")

    # pairs whose area difference is missing: any one boundary stands for them all
    one = F.min(F.struct((-F.col("src_prty")).alias("src_prty"), (-F.col("rol_prty_ciren")).alias("rol_prty_ciren"),
                         *[col(p).alias(p) for p in payload])).alias("_b")
    per_key = targets.groupBy("ROL", "b_name").agg(F.max(F.col("_v").isNull()).alias("_any_null"), one)
    unknown = join_inner(probes, per_key.hint("merge"), ["ROL", "b_name"]).where(col(size).isNull() | F.col("_any_null"))
    unknown = unknown.select(*[col(c) for c in probes.columns], F.lit(None).cast("double").alias(cad_area),
                             *[F.col("_b").getField(c).alias(c) for c in found_cols])

    both = with_size.unionByName(unknown).withColumn("area_diff", F.abs(col(cad_area) - col(size)))
    winners = best_per_group(
        both,
        [prop, "ROL", place],
        [
            F.col("name_dist"),
            F.col("area_diff"),
            -F.col("src_prty"),
            -(F.col("rol_prty") + F.col("rol_prty_ciren")),
        ],
        ties,
    )
    return winners.withColumns({"match_mthd": F.lit("ROL"), "match_prty": F.lit(1)}).withColumnRenamed("b_name", cad_place)


def match_rejected(
    rejected: DataFrame,
    cad: DataFrame,
    group: Sequence[str],
    raw_id: str = "rol",
    place: str = "comuna",
    cad_place: str = "desccomu",
    payload: Sequence[str] = ("poly_id", "polyarea"),
    ties: Sequence[str] = ("poly_id", "ROL"),
) -> DataFrame:
    """Best source per rejected application (all ``group`` columns), then ``ties``.

    Only the source ranks the boundaries, so they are reduced to one row per (identifier, place) first.
    """
    best = F.min(F.struct((-F.col("src_prty")).alias("s"), *[col(p).alias(p) for p in payload])).alias("_b")
    cad_best = cad.groupBy("ROL", col(cad_place).alias("b_name")).agg(best)
    cad_best = cad_best.select("ROL", "b_name", (-F.col("_b.s")).alias("src_prty"), *[F.col("_b").getField(p).alias(p) for p in payload])
    named = id_variants(rejected, raw_id, "ROL", "rol_prty").withColumn("_name", normalise_name(place))
    pairs = near_names(named, cad, "_name", cad_place)
    probes = named.join(pairs, named["_name"] == pairs["a_name"]).drop("_name", "a_name", "name_dist")
    both = join_inner(probes, cad_best, ["ROL", "b_name"])
    out = best_per_group(both, group, [-F.col("src_prty")], ties)
    return out.drop("src_prty", "rol_prty").withColumnRenamed("b_name", cad_place)


def unmatched(
    rejected: DataFrame, cad: DataFrame, raw_id: str = "rol", per_variant: bool = True, app: str = "app_id"
) -> DataFrame:
    """Rejected rows whose identifier is in no boundary source.

    ``per_variant`` tests each identifier form by itself, so an application matched through one form is
    still listed under the other; otherwise only applications unmatched in both forms are listed.
    """
    variants = id_variants(rejected, raw_id, "ROL", "rol_prty")
    missing = join_anti(variants, cad.select("ROL"), ["ROL"])
    if per_variant:
        return missing
    both = missing.groupBy(col(app).alias(app)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 2)
    return join_inner(missing, both.drop("_n"), [app]).where(F.col("rol_prty") == 1)


def combine_matches(
    frames: Sequence[DataFrame], cols: Sequence[str], keys: Sequence[str], ties: Sequence[str], cap: float = 200.0
) -> DataFrame:
    """Identifier match before spatial match, least area difference, ``ties``; then the cap on the difference."""
    stacked = None
    for df in frames:
        part = df.select(*[col(c) for c in cols])
        stacked = part if stacked is None else stacked.unionByName(part)
    return best_per_group(stacked, keys, [-F.col("match_prty"), F.col("area_diff")], ties).where(F.col("area_diff") <= cap)


def match_stands(
    stands: DataFrame,
    activities: DataFrame,
    on: Sequence[str],
    by: Sequence[str],
    stand_area: str,
    activity_area: str,
    stand_year: str,
    activity_year: str,
    absolute: bool = False,
) -> DataFrame:
    """Stands with their activities: same execution year, unknown year, or the least area difference of the group."""
    diff = col(stand_area) - col(activity_area)
    joined = join_left(stands, activities, on).withColumns(
        {
            "area_difference": F.abs(diff) if absolute else diff,
            "year_difference": col(stand_year).try_cast("double") - col(activity_year),
        }
    )
    also = (F.col("year_difference") == 0) | F.col("year_difference").isNull()
    return filter_group_extreme(joined, by, "area_difference", also)


# ---- administrative tables --------------------------------------------------------------------


def build_property_table(
    projects: DataFrame,
    properties: DataFrame,
    owners: DataFrame,
    project: str = "rptpro_id",
    prop: str = "rptpre_id",
    contest: str = "rptpro_tipo_concurso",
    bonus: str = "rptpro_tiene_bonificacion_saff",
    plan: str = "rptpro_tiene_plan_saff",
    raw_id: str = "rptpre_rol",
    other_label: str = "Otros Interesados",
) -> DataFrame:
    """Projects, properties and owners side by side with contest type, flags and identifier parts."""
    joined = join_full(materialise(join_full(projects, properties, [project])), owners, [prop])
    rol1, rol2 = split_id(raw_id, 2)
    contest_type = F.when(col(contest) == other_label, "Other interested").when(col(contest).isNotNull(), "Smallholder")
    return joined.withColumns(
        {
            "Contest type": contest_type,
            "received_bonus": flag_not_no(bonus),
            "submitted_management_plan": flag_not_no(plan),
            "rol1": rol1,
            "rol2": rol2,
            "additional_props": extra_part_flag(raw_id),
            "ROL": normalise_id(raw_id),
        }
    )


def build_activity_flags(
    property_table: DataFrame,
    stands: DataFrame,
    activities: DataFrame,
    values: Sequence[str],
    ids: Sequence[str] = ("rptpro_id", "rptpro_ano"),
    prop: str = "rptpre_id",
    stand: str = "rptro_id",
    label: str = "rptac_tipo",
) -> DataFrame:
    """One 0/1 column per activity type and (project, year); repeated rows are dropped before the joins.

    Properties without stands all miss the key of the second join, those without an id that of the first: they are spread.
    """
    keys = list(dict.fromkeys([*ids, prop]))
    base = property_table.select(*[col(k) for k in keys]).distinct()
    with_stands = join_left_spread(base, stands.select(col(prop), col(stand)).distinct(), [prop])
    types = activities.where(col(label).isin(*values)).select(col(stand), col(label)).distinct()
    with_types = join_left_spread(with_stands, types, [stand])
    return indicator_any(with_types, ids, label, values)


def build_size_sample(
    property_table: DataFrame,
    flags: DataFrame | None,
    keys: Sequence[str],
    order: Sequence[Column | str],
    size: str = "rptpre_superficie_predial",
    region: str = "rptpro_numero_region",
    bonus: str | None = "rptpro_tiene_bonificacion_saff",
    contest_type: str = "Contest type",
    amount: str = "rptpro_monto_total",
    bonus_area: str = "rptpro_superficie",
    flag_ids: Sequence[str] = ("rptpro_id", "rptpro_ano"),
) -> DataFrame:
    """Sample around the size limit: cutoff by region, centred size, ratios; first row per key.

    Every property row has its (project, year) among the flags, so the joint table is a left join.
    """
    df = join_left(property_table, flags, list(flag_ids)) if flags is not None else property_table
    sized = df.withColumnRenamed(size, "propertysize_reported").withColumn("size_cutoff", region_cutoff(region))
    reported = F.col("propertysize_reported")
    exprs = {
        "size_centered": reported - F.col("size_cutoff"),
        "below_cutoff": reported <= F.col("size_cutoff"),
        "smallholder": 1 - flag_equal(contest_type, "Other interested"),
        "price_per_hectare": ratio(amount, "propertysize_reported"),
        "proportion_bonusarea": ratio(bonus_area, "propertysize_reported"),
    }
    if bonus is not None:
        exprs["received_bonus"] = flag_equal(bonus, "Si")
    return first_per_key(sized.withColumns(exprs), keys, order)
