"""Scans of published files into typed rows; schemas are always explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hazardgrid import fixed_values as V
from hazardgrid.functions import spatial as S

_POSITIONS = "array<array<double>>"
GEOMETRY = f"struct<type:string,hasM:boolean,coordinates:string,paths:array<{_POSITIONS}>>"


class SourceContractError(ValueError):
    """A source does not have the agreed shape."""


def check_source_contract(available: dict[str, str] | T.StructType, required: list[str] | tuple[str, ...], *,
                          geometry_type: str | None = None, expected_geometry: str | None = None,
                          has_m: bool | None = None, needs_m: bool = False) -> None:
    """Geometry type, required fields and measures of a source, or an error."""
    names = set(available.names if isinstance(available, T.StructType) else available)
    if expected_geometry is not None and geometry_type != expected_geometry:
        raise SourceContractError(f"expected {expected_geometry}, got {geometry_type}")
    lacking = sorted(set(required) - names)
    if lacking:
        raise SourceContractError(f"missing fields: {', '.join(lacking)}")
    if needs_m and not has_m:
        raise SourceContractError("road source has no measures")


def _dashboard_header(spark: SparkSession, file: str, multi_line: bool) -> tuple[str, ...]:
    head = spark.read.option("multiLine", multi_line).option("encoding", "UTF-8").csv(file, header=False).limit(1).first()
    if head is None:
        raise SourceContractError("empty_csv")
    names = tuple((n or "").lstrip("\ufeff") for n in head)
    if len(set(names)) != len(names) or not set(V.DASHBOARD_REQUIRED) <= set(names):
        raise SourceContractError("missing_or_duplicate_columns")
    return names


def scan_dashboard_csv(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Headered UTF-8 CSV as strings, every file read by its own header; a bad header or row width fails the whole job.

    Columns are matched by name, whatever their order; a column that a file lacks is blank there.  An export is a handful of files, and only their
    header rows reach the driver.  With ``multi_line=False`` (no line breaks inside cells) one file is split over many tasks.
    """
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    if not files:
        raise SourceContractError("empty_csv")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        by_header.setdefault(_dashboard_header(spark, file, multi_line), []).append(file)
    rows = None
    for names, same in by_header.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = spark.read.schema(schema).csv(
            same, header=True, multiLine=multi_line, mode="FAILFAST", enforceSchema=False, encoding="UTF-8", quote='"', escape='"')
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rows = rows.fillna("")          # a blank cell is text, a short row already failed
    if rows.isEmpty():
        raise SourceContractError("empty_csv")
    return rows


def scan_feature_pages(spark: SparkSession, path: str, attributes: T.StructType, id_field: str,
                       expected: int | None = None, container: str = "attributes") -> DataFrame:
    """One row per feature of cached JSON pages, attributes as columns plus ``geometry``.

    Missing or repeated ids and a short count are errors.
    """
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
        T.StructField(container, attributes), T.StructField("geometry", T.StructType.fromDDL(GEOMETRY[7:-1]))])))])
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select(
        F.explode("features").alias("f")).select(f"f.{container}.*", "f.geometry")
    per_id = rows.groupBy(id_field).agg(F.count(F.lit(1)).alias("n"))
    total, missing, repeated = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col(id_field).isNull()), F.count_if(F.col("n") > 1)).first()
    if missing or repeated:
        raise SourceContractError(f"{missing} features without id, {repeated} repeated ids")
    if expected is not None and total != expected:
        raise SourceContractError(f"expected {expected} features, read {total}")
    return rows


def polygon_rings(geometry):
    """Ring list of a GeoJSON Polygon or MultiPolygon struct (coordinates as JSON text)."""
    text = geometry["coordinates"]
    multi = F.when(geometry["type"] == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).when(
        geometry["type"] == "MultiPolygon", text)
    return S.rings_from_coordinates(F.from_json(multi, "array<array<array<array<double>>>>"))


def line_points(geometry):
    """Points of a GeoJSON LineString struct (coordinates as JSON text)."""
    pairs = F.from_json(geometry["coordinates"], _POSITIONS)
    return F.when(geometry["type"] == "LineString", F.transform(
        pairs, lambda p: S.point(F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2)))))


# The text of each sample document, one JSON array per file.
_SAMPLE_SCHEMAS = {
    "municipalities": "muni_id int, name string, county string, muni_code string, center_lat double, center_lon double, boundary struct<type:string,coordinates:string>",
    "road_segments": "osm_id string, road_name string, road_type string, road_class string, length_miles double, muni_id int, geometry struct<type:string,coordinates:string>",
    "crashes": "crash_id long, external_id string, crash_date string, crash_time string, severity string, ped_involved boolean, bike_involved boolean, muni_id int, road_name string, latitude double, longitude double, geocode_quality string, weather_condition string, light_condition string",
    "census_tracts": "tract_id string, muni_id int, county_fips string, total_population long, median_income long, pct_below_poverty double, pct_no_vehicle double, pct_minority double, svi_score double, svi_percentile double, geometry struct<type:string,coordinates:string>",
}


def scan_sample_json(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four sample documents as typed frames with geometries as arrays."""
    out = {name: spark.read.schema(schema).json(f"{folder}/{name}.json", multiLine=True)
           for name, schema in _SAMPLE_SCHEMAS.items()}
    out["municipalities"] = out["municipalities"].withColumn("rings", polygon_rings(F.col("boundary"))).drop("boundary")
    out["road_segments"] = out["road_segments"].withColumn("pts", line_points(F.col("geometry"))).drop("geometry")
    out["census_tracts"] = out["census_tracts"].withColumn("rings", polygon_rings(F.col("geometry"))).drop("geometry")
    out["crashes"] = out["crashes"].withColumn("crash_date", F.try_to_date("crash_date", "yyyy-MM-dd"))
    return out


def scan_legacy_crash_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV as text columns, names as published."""
    return spark.read.csv(path, header=True, inferSchema=False)


def scan_road_features(spark: SparkSession, path: str, properties: T.StructType) -> DataFrame:
    """Road GeoJSON features with ``pts``; another reference system is refused."""
    schema = T.StructType([
        T.StructField("crs", T.StructType.fromDDL("properties struct<name:string>")),
        T.StructField("features", T.ArrayType(T.StructType([
            T.StructField("properties", properties),
            T.StructField("geometry", T.StructType.fromDDL("type string, coordinates string"))])))])
    pages = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
    name = F.upper(F.col("crs.properties.name"))
    other = pages.filter(name.isNotNull() & ~name.rlike(r"(CRS84|4326)$"))
    if not other.isEmpty():
        raise SourceContractError("road features must be in EPSG:4326")
    return pages.select(F.explode("features").alias("f")).select(
        "f.properties.*", line_points(F.col("f.geometry")).alias("pts"))


def scan_header_row_json(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of text whose first row names the columns; adds ``tract_id``.

    Every file is read by its own header; the order of columns may differ, their names may not.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("_file"), F.from_json("value", "array<array<string>>").alias("_rows"))
    headed = files.withColumn("_header", F.try_element_at("_rows", F.lit(1))).filter("_header IS NOT NULL")
    first = headed.orderBy("_file").select("_header").first()
    if first is None:
        raise SourceContractError("payload has no header row")
    names = first[0]
    if not headed.filter(F.array_sort("_header") != F.array_sort(F.array(*map(F.lit, names)))).isEmpty():
        raise SourceContractError("payloads disagree on their columns")
    rows = headed.select("_header", F.explode(F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0)))).alias("_row"))
    data = rows.select(*[F.try_element_at("_row", F.array_position("_header", n).cast("int")).alias(n) for n in names])
    return data.withColumn("tract_id", F.concat("state", "county", "tract"))


def scan_tract_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Tract polygons keyed by GEOID as ``tract_id, county_fips, rings``."""
    rows = scan_feature_pages(
        spark, path, T.StructType.fromDDL("GEOID string, COUNTYFP string"), "GEOID", container="properties")
    return rows.select(F.col("GEOID").alias("tract_id"), F.col("COUNTYFP").alias("county_fips"),
                       polygon_rings(F.col("geometry")).alias("rings"))
