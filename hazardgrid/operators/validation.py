"""Record validation: every row is either prepared or rejected with one reason.

Checks are ordered and the first failure wins.  Each check is a column, the
reason is one ``coalesce``, and good rows and rejects are two filters over the
same plan, so a source is parsed by built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardgrid import fixed_values as V
from hazardgrid.functions import numbers as N
from hazardgrid.functions import spatial as S
from hazardgrid.functions import text as T
from hazardgrid.session import small_methods, stage


def first_reason(*checks: tuple[Column, str | Column]) -> Column:
    """Reason of the first check that is true, NULL when none is."""
    return F.coalesce(*[
        F.when(F.coalesce(test, F.lit(False)), F.lit(reason) if isinstance(reason, str) else reason)
        for test, reason in checks])


def split_rejects(df: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """``(good, rejects)`` of a frame with a reason column."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


# --- crash archives ---------------------------------------------------------

def tag_crash(df: DataFrame, county: str | Column, year: int | Column) -> DataFrame:
    """Archive rows as prepared crashes plus ``reason``.

    ``county`` and ``year`` are what the archive claims to hold; Columns allow a
    frame of many archives.
    """
    county = F.lit(county) if isinstance(county, str) else county
    year = F.lit(year) if isinstance(year, int) else year
    parsed = {c: N.optional_nonneg_int(F.col(c)) for c in V.CASUALTY_COLUMNS}
    # Every parsed value becomes a column first, so that no check parses it again.
    df = df.withColumns({
        "_own": T.normalize_county(F.col("county_name")), "_id": T.strip(F.coalesce("id", F.lit(""))),
        "_day": N.us_date(F.col("crash_date")), "_severity": T.map_severity_fip(F.coalesce("severity", F.lit(""))),
        "_name": T.normalize_municipality(F.col("municipality_name")),
        **{f"_{c}": value for c, (value, _) in parsed.items()},
    })
    own, source_id, day, severity, name = (F.col(c) for c in ("_own", "_id", "_day", "_severity", "_name"))
    blank = {c: T.strip(F.coalesce(c, F.lit(""))) == "" for c in V.CASUALTY_COLUMNS}
    reason = first_reason(
        (own.isNull(), F.concat(F.lit("unknown county: "), F.coalesce("county_name", F.lit("")))),
        (own != T.normalize_county(county), "county"),
        (source_id == "", "source_id"),
        (day.isNull(), "date"),
        (F.year(day) != year, "year"),
        (severity.isNull(), "severity"),
        (name == "", "municipality_name"),
        *[(F.col(f"_{c}").isNull() & ~blank[c], c) for c in V.CASUALTY_COLUMNS],
    )
    place = F.when(F.coalesce("crash_location", F.lit("")) != "", F.col("crash_location")).otherwise(F.col("route"))
    carried = [c for c in ("archive", "line") if c in df.columns]
    return df.select(
        *carried,
        source_id.alias("source_id"), T.build_external_id(own, year, source_id).alias("external_id"),
        own.alias("county"), name.alias("municipality_name"), day.alias("crash_date"),
        T.blank_to_null(F.col("crash_time")).alias("crash_time"), severity.alias("severity"),
        (F.coalesce(F.col("_pedestrians_killed") > 0, F.lit(False))
         | F.coalesce(F.col("_pedestrians_injured") > 0, F.lit(False))).alias("ped_involved"),
        F.lit(None).cast("boolean").alias("bike_involved"),
        *[F.col(f"_{c}").alias(c) for c in V.CASUALTY_COLUMNS],
        T.blank_to_null(place).alias("road_name"),
        T.blank_to_null(F.col("light_condition")).alias("light_condition"),
        N.reported_point(F.col("latitude"), F.col("longitude")).alias("reported"),
        T.blank_to_null(F.upper("sri_std_rte_identifier")).alias("sri"),
        N.finite(N.parse_float(F.coalesce("milepost", F.lit("")))).alias("milepost"), reason.alias("reason"),
    )


def prepare_crash(df: DataFrame, county: str | Column, year: int | Column) -> tuple[DataFrame, DataFrame]:
    return split_rejects(tag_crash(df, county, year))


def municipality_keys(munis: DataFrame) -> DataFrame:
    """Lookup rows ``county, municipality_name, muni_id, muni_code`` with usable codes."""
    code = T.strip(F.coalesce("muni_code", F.lit("")))
    return munis.filter(code.rlike(r"^\d{1,4}$")).select(
        T.normalize_county(F.col("county")).alias("county"),
        T.normalize_municipality(F.col("name")).alias("municipality_name"),
        "muni_id", F.lpad(code, 4, "0").alias("muni_code"))


def municipality_lookup(munis: DataFrame) -> DataFrame:
    """``county, municipality_name`` with the number of candidates and the lowest one."""
    keyed = munis.select(
        T.normalize_county(F.col("county")).alias("county"),
        T.normalize_municipality(F.col("name")).alias("municipality_name"),
        "muni_id", *[c for c in ("muni_code",) if c in munis.columns])
    return keyed.groupBy("county", "municipality_name").agg(
        F.count(F.lit(1)).alias("candidates"), F.min_by(F.struct(*keyed.columns[2:]), "muni_id").alias("_m"),
    ).select("county", "municipality_name", "candidates", "_m.*")


def match_municipality(crashes: DataFrame, munis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(matched with muni_id, rejects)`` on county and normalised name."""
    lookup = municipality_lookup(munis).select("county", "municipality_name", "candidates", "muni_id")
    joined = crashes.join(lookup, ["county", "municipality_name"], "left")
    tagged = joined.withColumn("reason", first_reason(
        (F.col("candidates").isNull(), "municipality_unmatched"),
        (F.col("candidates") > 1, "municipality_ambiguous"))).drop("candidates")
    return split_rejects(tagged)


def dedupe_last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row per key in (file, line) order; combined map-side."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")


# --- person archives --------------------------------------------------------

def tag_person(df: DataFrame, county: Column, year: Column) -> DataFrame:
    """Companion person rows (``columns`` array) with key, flag and reason."""
    cols = F.col("columns")
    source_id = T.strip(F.try_element_at(cols, F.lit(1)))
    flag = F.upper(T.strip(F.try_element_at(cols, F.lit(V.PERSON_FLAG_COLUMN + 1))))
    canonical = T.normalize_county(county)
    reason = first_reason(
        (F.size(cols) != V.PERSON_COLUMNS, "columns"),
        (F.substring(source_id, 1, 4) != year.cast("string"), "year"),
        (F.substring(source_id, 5, 2) != T.county_code(canonical), "county"),
        (~F.substring(source_id, 7, 2).rlike(r"^\d\d$"), "municipality_code"),
        (T.strip(F.substring(source_id, 9, 1 << 20)) == "", "case_number"),
        (~flag.isin("", "Y", "N"), "bicycle_flag"))
    return df.withColumn("external_id", T.build_external_id(canonical, year, source_id)).withColumn(
        "bicycle", flag == "Y").withColumn("reason", reason)


# --- dashboard export -------------------------------------------------------

def reconcile_severity(code, crash_fatalities, fatal_flag, injury_evidence, fatality_counts) -> Column:
    """Severity from the rating and the evidence around it; NULL is unusable."""
    fatal = F.coalesce(crash_fatalities > 0, F.lit(False)) | F.coalesce(F.upper(fatal_flag) == "Y", F.lit(False))
    unqualified = F.lit(False)
    for c in fatality_counts:
        unqualified = unqualified | F.coalesce(c > 0, F.lit(False))
    is_o = F.coalesce(code == "O", F.lit(False))
    return (
        F.when(fatal, "fatal")
        .when(is_o & (injury_evidence | unqualified), "injury_unknown")
        .when(code.isNotNull(), T.lookup(V.KABCO_SEVERITY, code))
        .when(injury_evidence, "injury_unknown"))


def severity_conflicts(code, counts: dict[str, Column], fatal_flag, injury_evidence) -> Column:
    """Conflict codes in a fixed order."""
    fatal = F.coalesce(counts["crashfatalitycount"] > 0, F.lit(False)) | F.coalesce(F.upper(fatal_flag) == "Y", F.lit(False))
    is_o = F.coalesce(code == "O", F.lit(False))
    unqualified = (F.coalesce(counts["fatalitycount"] > 0, F.lit(False))
                   | F.coalesce(counts["pedestrianfatalitycount"] > 0, F.lit(False)))
    rating = (
        F.when(fatal, F.when(~F.coalesce(code == "K", F.lit(False)), "rating_with_fatal_evidence"))
        .when(is_o & injury_evidence, "rating_o_with_injury_evidence")
        .when(is_o & unqualified, "rating_o_with_unqualified_fatality_count")
        .when(code.isNull() & injury_evidence, "missing_rating_with_injury_evidence"))
    return F.array_compact(F.array(
        rating,
        F.when(counts["pedestrianfatalitycount"] > counts["fatalitycount"], "pedestrianfatalitycount_exceeds_total"),
        F.when(counts["pedestrianinjurycount"] > counts["injurycount"], "pedestrianinjurycount_exceeds_total"),
        F.when((code == "K") & (counts["fatalitycount"] == 0), "fatal_rating_with_zero_fatalities"),
        F.when(code.isin("A", "B", "C") & (counts["injurycount"] == 0), "injury_rating_with_zero_injured")))


def involvement_flags(labels, crash_type, counts: dict[str, Column]) -> tuple[Column, Column]:
    """``(pedestrian, bicycle)``; a bicycle is either seen or unknown."""
    pedestrian = (
        F.coalesce(F.array_contains(labels, V.PEDESTRIAN_LABEL), F.lit(False))
        | F.coalesce(crash_type == "Pedestrian", F.lit(False))
        | F.coalesce(counts["pedestrianinjurycount"] > 0, F.lit(False))
        | F.coalesce(counts["pedestrianfatalitycount"] > 0, F.lit(False)))
    seen = F.arrays_overlap(labels, F.array(*[F.lit(x) for x in V.BICYCLE_LABELS]))
    return pedestrian, F.when(seen, F.lit(True))


def public_metadata(columns: list[str], conflicts: Column, source_url: str | None = None,
                    retrieved_at: str | None = None, file_sha256: str | None = None) -> Column:
    """Whitelisted source fields with provenance; nothing else leaves the source row."""
    raw = F.struct(*[F.col(f"`{c}`").alias(c) for c in V.DASHBOARD_PUBLIC if c in columns])
    text = lambda v: F.lit(v).cast("string")
    return F.struct(
        F.lit(V.DASHBOARD_SOURCE).alias("source"), F.lit(V.DASHBOARD_SCHEMA_VERSION).alias("schema_version"),
        raw.alias("raw"), conflicts.alias("conflicts"),
        F.struct(text(source_url).alias("source_url"), text(retrieved_at).alias("retrieved_at"),
                 text(file_sha256).alias("file_sha256")).alias("provenance"))


def tag_dashboard(df: DataFrame, munis: DataFrame, **provenance) -> DataFrame:
    """Dashboard rows as prepared records plus ``reason``; keeps ``line`` when present."""
    def cell(name):
        return F.coalesce(F.col(f"`{name}`"), F.lit("")) if name in df.columns else F.lit("")

    dash_id = T.strip(cell("id_cr"))
    county = T.normalize_county(cell("County"))
    label = T.strip(cell("Municipality"))
    has_suffix = label.contains(",")
    suffix = F.regexp_extract(label, r",([^,]*)$", 1)
    name = F.when(has_suffix, F.regexp_replace(label, r",[^,]*$", "")).otherwise(label)
    suffix_county = T.normalize_county(suffix)
    day = N.iso_date(cell("dateofcrash"))
    case = T.strip(cell("casenumber"))
    when_text = T.strip(cell("Date & Time of Crash"))
    when = N.iso_timestamp(when_text)
    parsed = {c: N.dashboard_count(cell(c)) for c in V.DASHBOARD_COUNTS}
    labels = T.summary_labels(cell("NJDOT Summary"))
    code = T.kabco_code(cell("Highest Injury Severity Rating"))
    base = df.withColumns({
        "_county": county, "_name": T.normalize_municipality(name), "_day": day, "_when": when,
        "_labels": labels, "_code": code, **{f"_{c}": v for c, (v, _) in parsed.items()}})
    injury = (
        F.coalesce(F.col("_injurycount") > 0, F.lit(False)) | F.coalesce(F.col("_pedestrianinjurycount") > 0, F.lit(False))
        | F.coalesce(F.array_contains("_labels", V.INJURY_LABEL), F.lit(False)))
    base = base.withColumn("_injury", injury)
    lookup = municipality_keys(munis).groupBy("county", "municipality_name").agg(
        F.count(F.lit(1)).alias("_candidates"), F.min_by(F.struct("muni_id", "muni_code"), "muni_id").alias("_m"),
    ).withColumnsRenamed({"county": "_county", "municipality_name": "_name"})
    # Wide rows are not shuffled to the few municipality names there are: one task would get all rows of a city.
    joined = base.join(F.broadcast(lookup), ["_county", "_name"], "left")

    counts = {c: F.col(f"_{c}") for c in V.DASHBOARD_COUNTS}
    injury = F.col("_injury")
    joined = joined.withColumn("_severity", reconcile_severity(
        F.col("_code"), counts["crashfatalitycount"], cell("fatalcrashind"), injury,
        (counts["fatalitycount"], counts["pedestrianfatalitycount"])))
    severity = F.col("_severity")
    conflicts = severity_conflicts(F.col("_code"), counts, cell("fatalcrashind"), injury)
    pedestrian, bicycle = involvement_flags(F.col("_labels"), cell("Crash Type"), counts)
    y1, y2 = V.DASHBOARD_YEARS
    year = F.year("_day")
    reason = first_reason(
        (~dash_id.rlike(r"^\d{1,64}$"), "invalid_dashboard_id"),
        (F.col("_county").isNull(), F.concat(F.lit("unknown county: "), cell("County"))),
        (has_suffix & suffix_county.isNull(), F.concat(F.lit("unknown county: "), suffix)),
        (has_suffix & (suffix_county != F.col("_county")), "municipality_county_conflict"),
        (F.col("_candidates").isNull(), "municipality_unmatched"),
        (F.col("_candidates") > 1, "municipality_ambiguous"),
        (F.col("_day").isNull(), "invalid_date"),
        (year.cast("string") != T.strip(cell("Year")), "year_date_conflict"),
        (~year.between(y1, y2), f"outside_{y1}_{y2}"),
        ((case == "") | (F.length(case) > 200), "invalid_case_number"),
        ((when_text != "") & F.col("_when").isNull(), "invalid_datetime"),
        (F.to_date("_when") != F.col("_day"), "datetime_date_conflict"),
        *[(counts[c].isNull() & (T.strip(cell(c)) != ""), "invalid_" + c) for c in V.DASHBOARD_COUNTS],
        (F.col("_labels").isNull(), "invalid_summary"),
        (severity.isNull(), "unrecognized_severity"),
    )
    geopoint = cell("Geopoint")
    reported = F.when(geopoint != "", N.json_point(geopoint)).otherwise(
        N.bounded_point(cell("longitude"), cell("latitude")))
    legacy = F.concat(year.cast("string"), F.col("_m.muni_code"), case)
    carried = [c for c in ("line",) if c in df.columns]
    return joined.select(
        *carried, dash_id.alias("dashboard_id"), T.strip(cell("Year")).alias("source_year"),
        T.build_external_id(F.col("_county"), year, legacy).alias("external_id"),
        F.col("_day").alias("crash_date"), F.date_format("_when", "HH:mm").alias("crash_time"), year.alias("year"),
        F.col("_m.muni_id").alias("muni_id"), severity.alias("severity"), pedestrian.alias("ped_involved"),
        bicycle.alias("bike_involved"), counts["fatalitycount"].alias("total_killed"),
        counts["injurycount"].alias("total_injured"), counts["pedestrianfatalitycount"].alias("pedestrians_killed"),
        counts["pedestrianinjurycount"].alias("pedestrians_injured"),
        T.clip(cell("streetname"), 200).alias("road_name"), T.clip(cell("streetsri"), 20).alias("route_number"),
        T.clip(cell("Weather Condition"), 50).alias("weather_condition"),
        reported.alias("reported_point"), N.json_point(cell("Geopoint (Calculated)")).alias("calculated_point"),
        public_metadata(df.columns, conflicts, **provenance).alias("source_metadata"), reason.alias("reason"),
    )


def prepare_dashboard(df: DataFrame, munis: DataFrame, **provenance) -> tuple[DataFrame, DataFrame]:
    return split_rejects(tag_dashboard(df, munis, **provenance))


def payload_digest(tagged: DataFrame) -> Column:
    """What makes two rows of one id the same record."""
    columns = [c for c in tagged.columns if c not in ("line", "reason", "source_year")]
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def identity_problems(tagged: DataFrame) -> DataFrame:
    """``dashboard_id, first_line, problem`` of accepted ids that are repeated or in conflict, from narrow columns only.

    ``tagged`` has ``dashboard_id, external_id, line, reason, payload``.
    """
    good = tagged.filter(F.col("reason").isNull())
    by_id = good.groupBy("dashboard_id").agg(
        F.count(F.lit(1)).alias("n"), (F.min("payload") != F.max("payload")).alias("conflict"), F.min("line").alias("first_line"),
        F.min_by("external_id", "line").alias("external"))
    # An id claims the external id of its first row, also when its rows conflict.
    shared = by_id.groupBy("external").agg(F.count(F.lit(1)).alias("ids")).filter("ids > 1").select("external", F.lit(True).alias("shared"))
    problem = first_reason((F.col("conflict"), "conflicting_dashboard_id"), (F.col("shared"), "ambiguous_legacy_identity"))
    return by_id.join(shared, "external", "left").select("dashboard_id", "n", "first_line", problem.alias("problem")).filter(
        "n > 1 OR problem IS NOT NULL").drop("n")


def duplicate_identity_audit(tagged: DataFrame) -> DataFrame:
    """Extend ``reason`` with identity problems and mark exact repeats.

    Same id with another payload rejects all its rows; several ids claiming one external id reject all of them; equal payloads keep one row
    (``repeat`` false).  Rows that have a reason already take no part in the join, so a placeholder id of many of them is no hot key.  ``tagged`` is
    evaluated once, whoever reads the result and how often.
    """
    with small_methods(tagged.sparkSession):
        staged = stage(tagged.withColumn("_payload", payload_digest(tagged)), "dashboard-tagged")
    narrow = staged.select("dashboard_id", "external_id", "line", "reason", F.col("_payload").alias("payload"))
    tagged = staged.drop("_payload")
    good, bad = tagged.filter(F.col("reason").isNull()), tagged.filter(F.col("reason").isNotNull())
    judged = good.join(identity_problems(narrow), "dashboard_id", "left").withColumn("reason", F.col("problem")).withColumn(
        "repeat", F.col("reason").isNull() & F.coalesce(F.col("line") > F.col("first_line"), F.lit(False))).drop("problem", "first_line")
    return judged.unionByName(bad.withColumn("repeat", F.lit(False)))


def audit_counts(audited: DataFrame) -> DataFrame:
    """Input, eligible, repeated and quarantined rows per source year."""
    bad = F.col("reason").isNotNull()
    return audited.groupBy("source_year").agg(
        F.count(F.lit(1)).alias("input"), F.count_if(~bad & ~F.col("repeat")).alias("eligible"),
        F.count_if(F.col("repeat")).alias("duplicates"), F.count_if(bad).alias("quarantined"))


def dashboard_details(crashes: DataFrame) -> DataFrame:
    """Public detail fields of dashboard crashes as columns; NULL for other sources."""
    meta = F.col("source_metadata")
    ours = F.coalesce((meta["source"] == V.DASHBOARD_SOURCE)
                      & (meta["schema_version"] == V.DASHBOARD_SCHEMA_VERSION), F.lit(False))
    fields = {f.name: f.dataType for f in crashes.schema["source_metadata"].dataType.fields}
    raw_names = set(fields["raw"].names) if "raw" in fields else set()
    origin = set(fields["provenance"].names) if "provenance" in fields else set()

    def text(value, limit):
        return F.when(ours, T.clip(value, limit))

    null = F.lit(None).cast("string")
    out = {"source_name": F.when(ours, F.lit(V.DASHBOARD_SOURCE_NAME)), "dashboard_id": text(F.col("dashboard_id"), 64)}
    for field, header in V.DASHBOARD_DETAIL_FIELDS.items():
        out[field] = text(meta["raw"][header], 200) if header in raw_names else null
    out["location_method"] = text(meta["location_method"], 40) if "location_method" in fields else null
    out["source_url"] = text(meta["provenance"]["source_url"], 500) if "source_url" in origin else null
    out["source_retrieved_at"] = text(meta["provenance"]["retrieved_at"], 40) if "retrieved_at" in origin else null
    known = F.array(*[F.lit(c) for c in V.SEVERITY_CONFLICTS])
    out["severity_conflict"] = F.when(ours, F.coalesce(F.arrays_overlap(meta["conflicts"], known), F.lit(False)))
    out["source_conflict"] = F.when(ours, F.coalesce(F.size(meta["conflicts"]) > 0, F.lit(False)))
    return crashes.withColumns(out)


def export_counts_by_year(df: DataFrame) -> DataFrame:
    """``year, rows`` of an export, by the text of its year column."""
    return df.groupBy(T.strip(F.coalesce("Year", F.lit(""))).alias("year")).agg(F.count(F.lit(1)).alias("rows"))


def validate_export(df: DataFrame, y1: int, y2: int, expected_rows: int | None = None) -> DataFrame:
    """One row of problem counts for a dashboard export, plus rows and distinct ids.

    ``missing_rows`` is how many fewer rows there are than expected (negative: more), null without an expectation.
    """
    year_text = T.strip(F.coalesce("Year", F.lit("")))
    year = F.when(year_text.rlike(r"^\d+$"), year_text.try_cast("long"))
    day = N.iso_date(F.col("dateofcrash"))
    source_id = T.strip(F.coalesce("id_cr", F.lit("")))
    # Ids are grouped first, so that distinct counting combines map-side.
    reason = first_reason(
        (year.isNull() | ~year.between(y1, y2), "year"), (day.isNull(), "date"),
        (F.year(day) != year, "date_year"), (~source_id.rlike(r"^\d+$"), "id"))
    per_id = df.select(source_id.alias("id"), reason.alias("reason")).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("year", "date", "date_year")],
        F.count_if(F.col("reason") == "id").alias("bad_id"))
    return per_id.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique_ids"), F.sum("year").alias("outside_years"),
        F.sum("date").alias("invalid_dates"), F.sum("date_year").alias("date_year_conflicts"),
        F.sum("bad_id").alias("invalid_ids"), F.sum(F.col("n") - 1).alias("duplicate_ids"),
        (F.lit(expected_rows).cast("bigint") - F.coalesce(F.sum("n"), F.lit(0))).alias("missing_rows"))


# --- legacy crash CSV ---------------------------------------------------------

def standardize_legacy_crashes(df: DataFrame) -> DataFrame:
    """Alias names, known vocabularies, bounds and essential fields of a legacy CSV; rows that miss an essential field go, see :func:`legacy_drops`."""
    kept = tag_legacy_crashes(df)
    return kept.filter(F.col("reason").isNull()).drop("reason")


def legacy_drops(df: DataFrame) -> DataFrame:
    """``reason, records`` of the rows that :func:`standardize_legacy_crashes` leaves out."""
    return tag_legacy_crashes(df).filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def tag_legacy_crashes(df: DataFrame) -> DataFrame:
    """Standardised rows with ``reason``: ``date``, ``coordinates`` (missing or no numbers) or ``bounds``.

    A date is a whole ISO or US date, alone or before a time of day.
    """
    df = df.withColumnsRenamed({k: v for k, v in V.LEGACY_COLUMN_ALIASES.items() if k in df.columns})
    text = F.col("crash_date").cast("string")
    # The whole cell must have the form; what follows the date must be a time.
    form = r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{1,2}/\d{1,2}/\d{4})([T ]\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?( ?[AaPp][Mm])?(Z|[+-]\d{2}:?\d{2})?)?$"
    date = F.nullif(F.regexp_extract(T.strip(text), form, 1), F.lit(""))
    day = F.coalesce(N.iso_date(date), N.us_date(date))
    out = {
        "crash_date": day,
        "severity": F.coalesce(T.lookup(V.LEGACY_SEVERITY, F.lower("severity")), F.lit("property_damage")),
        "latitude": N.finite(N.parse_float(F.col("latitude").cast("string"))),
        "longitude": N.finite(N.parse_float(F.col("longitude").cast("string"))),
        "geocode_quality": F.lit("medium"),
    }
    for flag in ("ped_involved", "bike_involved"):
        if flag in df.columns:
            out[flag] = F.coalesce(F.lower(F.col(flag).cast("string")).isin(*V.LEGACY_TRUE), F.lit(False))
    return df.withColumns(out).withColumn("reason", first_reason(
        (F.col("crash_date").isNull(), "date"), (F.col("longitude").isNull() | F.col("latitude").isNull(), "coordinates"),
        (~N.inside_bounds(F.col("longitude"), F.col("latitude"), V.LEGACY_BOUNDS), "bounds")))


# --- tracts, boundaries, roads -------------------------------------------------

def tag_svi(df: DataFrame) -> DataFrame:
    """SVI features (properties as columns, ``geometry_type``, ``rings``) plus ``reason``."""
    tract = T.strip(F.coalesce(F.col("FIPS").cast("string"), F.lit("")))
    rank, bad_rank = N.optional_number(F.col("RPL_THEMES"), 0, 1)
    people, bad_people = N.optional_number(F.col("E_TOTPOP"), 0, integer=True)
    vehicle, bad_vehicle = N.optional_number(F.col("EP_NOVEH"), 0, 100)
    minority, bad_minority = N.optional_number(F.col("EP_MINRTY"), 0, 100)
    percentile = F.round(rank * 100, 6)
    shape = F.coalesce(F.col("geometry_type").isin("Polygon", "MultiPolygon"), F.lit(False)) & (F.size("rings") > 0)
    reason = first_reason(
        (~F.col("ST_ABBR").eqNullSafe(F.lit(V.STATE_ABBR)), "state"),
        (~tract.rlike(rf"^{V.STATE_FIPS}\d{{9}}$"), "tract_id"),
        (~F.coalesce(shape, F.lit(False)), "geometry"),
        (bad_rank, "svi_percentile"), (bad_people, "total_population"),
        (bad_vehicle, "pct_no_vehicle"), (bad_minority, "pct_minority"))
    return df.select(
        tract.alias("tract_id"), F.substring(tract, 3, 3).alias("county_fips"), people.alias("total_population"),
        F.lit(None).cast("int").alias("median_income"), vehicle.alias("pct_no_vehicle"), minority.alias("pct_minority"),
        percentile.alias("svi_score"), percentile.alias("svi_percentile"),
        F.lit(V.SVI_SOURCE_YEAR).alias("source_year"), "rings", reason.alias("reason"))


def normalize_svi(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_rejects(tag_svi(df))


def normalize_boundary(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Municipality boundaries; the first feature of a code is kept, later ones rejected.

    Expects ``MUN_CODE, MUN_LABEL, NAME, COUNTY, MUN_TYPE, geometry_type, rings`` and
    ``seq``, the feature's position.
    """
    code = T.strip(F.coalesce(F.col("MUN_CODE").cast("string"), F.lit("")))
    name = T.strip(F.when(F.coalesce("MUN_LABEL", F.lit("")) != "", F.col("MUN_LABEL")).otherwise(F.coalesce("NAME", F.lit(""))))
    county = T.title_words(T.strip(F.coalesce("COUNTY", F.lit(""))))
    kind = T.strip(F.coalesce("MUN_TYPE", F.lit("")))
    shape = F.coalesce(F.col("geometry_type").isin("Polygon", "MultiPolygon") & (F.size("rings") > 0), F.lit(False))
    tagged = df.select(
        "seq", code.alias("muni_code"), name.alias("name"), county.alias("county"), kind.alias("muni_type"), "rings",
        first_reason(((code == "") | (name == "") | (county == "") | (kind == ""), "required_fields"),
                     (~shape, "boundary_geometry")).alias("reason"))
    firsts = tagged.filter(F.col("reason").isNull()).groupBy("muni_code").agg(F.min("seq").alias("_first"))
    joined = tagged.join(firsts, "muni_code", "left").withColumn("reason", F.coalesce(
        "reason", F.when(F.col("seq") > F.col("_first"), F.lit("duplicate_code")))).drop("_first")
    return split_rejects(joined)


def parse_road_feature(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(paths, routes, rejects)`` of road features.

    Expects ``OBJECTID, sri, f_system_code`` and ``paths`` (arrays of [x, y(, m)]).
    A path needs two distinct finite vertices; a route also needs measures that
    never reverse.  Rejects carry ``source_id, kind, reason``.
    """
    oid = T.strip(F.coalesce(F.col("OBJECTID").cast("string"), F.lit("")))
    sri = F.upper(T.strip(F.coalesce("sri", F.lit(""))))
    feature_reason = first_reason(
        (oid == "", "no_object_id"), (sri == "", "no_sri"), (F.length(sri) > 20, "sri_too_long"),
        (F.col("paths").isNull() | (F.size("paths") == 0), "no_paths"))
    features = df.select(
        F.concat(F.lit(f"{V.SOURCE_PREFIX}:"), oid).alias("feature_id"), sri.alias("sri"),
        T.functional_road_class(F.col("f_system_code")).alias("_class"), "paths", feature_reason.alias("reason"))
    exploded = features.filter(F.col("reason").isNull()).select(
        "feature_id", "sri", "_class.*", F.posexplode("paths").alias("_i", "_path"),
    ).withColumn("source_id", F.concat_ws(":", "feature_id", F.col("_i").cast("string")))

    def usable(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))

    def part(p, i):
        return F.try_element_at(p, F.lit(i))

    xy_ok = F.forall("_path", lambda p: usable(part(p, 1)) & usable(part(p, 2)) & (F.abs(part(p, 1)) <= 180) & (F.abs(part(p, 2)) <= 90))
    pts = F.transform("_path", lambda p: S.point(part(p, 1), part(p, 2)))
    path_reason = first_reason(
        (F.col("_path").isNull() | (F.size("_path") < 2), "fewer_than_two_vertices"),
        (~F.coalesce(xy_ok, F.lit(False)), "invalid_xy"), (F.size(F.array_distinct(pts)) < 2, "no_length"))
    measures = F.transform("_path", lambda p: part(p, 3))
    steps = F.zip_with(F.slice(measures, 2, F.greatest(F.size(measures) - 1, F.lit(0))),
                       F.slice(measures, 1, F.greatest(F.size(measures) - 1, F.lit(0))), lambda b, a: b - a)
    reverses = F.exists(steps, lambda d: d > 0) & F.exists(steps, lambda d: d < 0)
    m_ok = F.forall(measures, usable)
    tagged = exploded.withColumn("reason", path_reason).withColumn(
        "route_reason", first_reason((~F.coalesce(m_ok, F.lit(False)) | reverses, "invalid_measures")))
    good = tagged.filter(F.col("reason").isNull())
    paths = good.select("source_id", "sri", F.col("sri").alias("road_name"), "road_type", "road_class", pts.alias("pts"))
    measured = F.transform("_path", lambda p: F.struct(part(p, 1).alias("x"), part(p, 2).alias("y"), part(p, 3).alias("m")))
    routes = good.filter(F.col("route_reason").isNull()).select(
        "source_id", "sri", F.array_min(measures).alias("mp_start"), F.array_max(measures).alias("mp_end"), measured.alias("pts"))
    rejects = (
        features.filter(F.col("reason").isNotNull()).select(F.col("feature_id").alias("source_id"), F.lit("feature").alias("kind"), "reason")
        .unionByName(tagged.filter(F.col("reason").isNotNull()).select("source_id", F.lit("analysis").alias("kind"), "reason"))
        .unionByName(good.filter(F.col("route_reason").isNotNull()).select("source_id", F.lit("reference").alias("kind"), F.col("route_reason").alias("reason"))))
    return paths, routes, rejects


def classify_osm_roads(df: DataFrame, col: str = "highway") -> DataFrame:
    return df.withColumn("road_class", T.osm_road_class(F.col(col)))
