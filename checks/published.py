"""Published files: tables written in the form of their source, scanned, and held against the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from checks.registry import query
from checks.views import view
from hazardgrid import fixed_values as V
from hazardgrid.functions import spatial as S
from hazardgrid.session import new_folder
from hazardgrid.sources import files as X


def written(pages, name: str) -> str:
    """``page, value`` (one row a page) as one file for each page; the path that reads them all."""
    folder = new_folder(pages.sparkSession, name)
    pages.repartition("page").write.partitionBy("page").text(folder)
    return f"{folder}/page=*"


#: Features of a page at most; a service hands out a large layer in more pages, not in longer ones.
PAGE_FEATURES = 10_000


def page_of(key: str, pages: int = 6):
    return (F.col(key) % pages).cast("int").alias("page")


def feature_pages(df, key: str, feature, **head):
    """Pages ``{..., "features": [...]}`` of one feature a row."""
    extra = [v.alias(k) for k, v in head.items()]
    pages = max(6, -(-df.count() // PAGE_FEATURES))
    return df.groupBy(page_of(key, pages)).agg(F.collect_list(feature).alias("features")).select("page", F.to_json(F.struct(*extra, "features")).alias("value"))


def square(x, y):
    """The outline of a unit box as nested coordinates."""
    corner = lambda dx, dy: F.array(x + dx, y + dy)
    return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))


_PARTS = """SELECT p_partkey, CONCAT(' r', CAST(p_partkey % 40 AS STRING)) AS sri, CAST(p_size AS INT) AS code, CAST(p_partkey % 80 AS DOUBLE) / CAST(4 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part"""
_SUPPLY = """SELECT s_suppkey, CONCAT('34', LPAD(CAST(s_suppkey AS STRING), 9, '0')) AS geoid, LPAD(CAST(s_suppkey % 21 AS STRING), 3, '0') AS county, CAST(s_suppkey % 80 AS DOUBLE) / CAST(4 AS DOUBLE) AS x,
 CAST(s_suppkey % 7 AS DOUBLE) AS y FROM supplier"""


@query("scan_feature_pages", f"SELECT p_partkey AS id, sri, code, 3 AS points, x AS from_x, x + 1 AS last_measure FROM ({_PARTS}) p")
def scan_feature_pages(spark, d):
    df = view(spark, d, "part", _PARTS)
    x, y = F.col("x"), F.col("y")
    path = F.array(F.array(x, y, x), F.array(x + 0.5, y, x + 0.5), F.array(x + 1.0, y, x + 1.0))
    feature = F.struct(F.struct(F.col("p_partkey").alias("OBJECTID"), "sri", "code").alias("attributes"), F.struct(F.lit(True).alias("hasM"), F.array(path).alias("paths")).alias("geometry"))
    rows = X.scan_feature_pages(spark, written(feature_pages(df, "p_partkey", feature), "pages-features"), StructType.fromDDL("OBJECTID long, sri string, code int"), "OBJECTID", expected=df.count())
    line = F.col("geometry.paths")[0]
    return rows.select(F.col("OBJECTID").alias("id"), "sri", "code", F.size(line).alias("points"), line[0][0].alias("from_x"), line[2][2].alias("last_measure"))


@query("scan_road_features", f"SELECT p_partkey AS id, code, 2 AS points, x AS from_lon, y + 1 AS to_lat FROM ({_PARTS}) p")
def scan_road_features(spark, d):
    df = view(spark, d, "part", _PARTS)
    line = F.array(F.array("x", "y"), F.array(F.col("x") + 1, F.col("y") + 1))
    feature = F.struct(F.struct(F.col("p_partkey").alias("id"), "code").alias("properties"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"))
    crs = F.struct(F.struct(F.lit("urn:ogc:def:crs:OGC:1.3:CRS84").alias("name")).alias("properties"))
    rows = X.scan_road_features(spark, written(feature_pages(df, "p_partkey", feature, crs=crs), "pages-roads"), StructType.fromDDL("id long, code int"))
    return rows.select("id", "code", F.size("pts").alias("points"), F.col("pts")[0]["x"].alias("from_lon"), F.col("pts")[1]["y"].alias("to_lat"))


@query("scan_tract_boundaries", f"SELECT geoid AS tract_id, county AS county_fips, 1 + CAST(s_suppkey % 2 AS INT) AS rings, x, y + 1 AS top FROM ({_SUPPLY}) s")
def scan_tract_boundaries(spark, d):
    df = view(spark, d, "supplier", _SUPPLY)
    one = square(F.col("x"), F.col("y"))
    multi = F.col("s_suppkey") % 2 == 1
    # Coordinates of a polygon are rings, of a multipolygon polygons: written as text, embedded as it is.
    body = F.when(multi, F.to_json(F.array(F.array(one), F.array(one)))).otherwise(F.to_json(F.array(one)))
    text = F.concat(F.lit('{"properties":{"GEOID":"'), "geoid", F.lit('","COUNTYFP":"'), "county", F.lit('"},"geometry":{"type":"'),
                    F.when(multi, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), body, F.lit("}}"))
    pages = df.groupBy(page_of("s_suppkey")).agg(F.array_join(F.collect_list(text), ",").alias("t")).select("page", F.concat(F.lit('{"features":['), "t", F.lit("]}")).alias("value"))
    rows = X.scan_tract_boundaries(spark, written(pages, "pages-tracts"))
    return rows.select("tract_id", "county_fips", F.size("rings").alias("rings"), F.col("rings")[0][0]["x"].alias("x"), F.col("rings")[0][2]["y"].alias("top"))


@query("scan_header_row_json", f"SELECT geoid AS tract_id, CAST(s_suppkey AS VARCHAR) AS amount FROM ({_SUPPLY}) s")
def scan_header_row_json(spark, d):
    df = view(spark, d, "supplier", _SUPPLY)
    cells = {"state": F.substring("geoid", 1, 2), "county": F.substring("geoid", 3, 3), "tract": F.substring("geoid", 6, 6), "amount": F.col("s_suppkey").cast("string")}
    turned = F.col("s_suppkey") % 6 >= 3                  # half of the files have their columns in the other order
    row = F.when(turned, F.array(*[cells[c] for c in reversed(cells)])).otherwise(F.array(*cells.values()))
    head = F.when(F.col("page") >= 3, F.array(*[F.lit(c) for c in reversed(cells)])).otherwise(F.array(*[F.lit(c) for c in cells]))
    pages = df.groupBy(page_of("s_suppkey")).agg(F.collect_list(row).alias("rows")).select("page", F.to_json(F.concat(F.array(head), F.col("rows"))).alias("value"))
    return X.scan_header_row_json(spark, written(pages, "pages-census")).select("tract_id", "amount")


_CELLS = """SELECT o_orderkey, CONCAT('a "quoted", ', CAST(o_custkey AS STRING)) AS DATE_, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'PDO' END AS SEVERITY FROM orders"""


@query("scan_legacy_crash_csv", f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, DATE_, SEVERITY FROM ({_CELLS}) q")
def scan_legacy_crash_csv(spark, d):
    folder = new_folder(spark, "pages-legacy")
    view(spark, d, "orders", _CELLS).write.csv(folder, header=True, escape="\\")
    return X.scan_legacy_crash_csv(spark, folder)


@query("scan_dashboard_csv", "SELECT id_cr, county, municipality, CASE WHEN line % 2 = 0 THEN 'x' || chr(10) || 'y' ELSE '' END AS extra, streetname, geopoint FROM t_dash")
def scan_dashboard_csv(spark, d):
    from checks.ingest import raw_dash
    raw = raw_dash(spark, d)
    folder = new_folder(spark, "pages-dashboard")
    lacking = [F.lit("").alias(c) for c in V.DASHBOARD_REQUIRED if c not in raw.columns]
    full = raw.select("*", *lacking)
    names = [c for c in full.columns if c != "line"]
    # Two kinds of files: other orders of the columns, and a column that only one kind has, with a line break in its cells.
    for part, columns in ((0, [*reversed(names), "extra"]), (1, names)):
        full.withColumn("extra", F.lit("x\ny")).filter(F.col("line") % 2 == part).select(*columns).write.csv(f"{folder}/{part}", header=True, quote='"', escape='"', emptyValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = X.scan_dashboard_csv(spark, f"{folder}/*")
    return rows.select("id_cr", F.col("County").alias("county"), F.col("Municipality").alias("municipality"), "extra", "streetname", F.col("Geopoint").alias("geopoint"))


@query("scan_sample_json", f"""SELECT 'municipality' AS kind, CAST(s_suppkey AS VARCHAR) AS id, 5 AS points, x FROM ({_SUPPLY}) s UNION ALL SELECT 'road', CAST(s_suppkey AS VARCHAR), 2, x FROM ({_SUPPLY}) s
UNION ALL SELECT 'tract', geoid, 5, x FROM ({_SUPPLY}) s UNION ALL SELECT 'crash', CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END, x FROM ({_SUPPLY}) s""")
def scan_sample_json(spark, d):
    df = view(spark, d, "supplier", _SUPPLY)
    folder = new_folder(spark, "pages-sample")
    one = square(F.col("x"), F.col("y"))
    shape = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("coordinates"))
    documents = {
        "municipalities": F.struct(F.col("s_suppkey").cast("int").alias("muni_id"), shape("Polygon", F.array(one)).alias("boundary")),
        "road_segments": F.struct(F.col("s_suppkey").cast("string").alias("osm_id"), shape("LineString", F.array(F.array("x", "y"), F.array("y", "x"))).alias("geometry")),
        "crashes": F.struct(F.col("s_suppkey").alias("crash_id"), F.when(F.col("s_suppkey") % 3 == 0, "soon").otherwise("2022-01-02").alias("crash_date"), F.col("x").alias("longitude")),
        "census_tracts": F.struct(F.col("geoid").alias("tract_id"), shape("MultiPolygon", F.array(F.array(one))).alias("geometry")),
    }
    for name, document in documents.items():
        df.groupBy(page_of("s_suppkey")).agg(F.to_json(F.collect_list(document)).alias("value")).repartition("page").select("value").write.option(
            "maxRecordsPerFile", 1).text(f"{folder}/{name}.json")
    out = X.scan_sample_json(spark, folder)

    def item(df, kind, key, points, x):
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), points.cast("int").alias("points"), x.alias("x"))

    ring = F.col("rings")[0]
    return item(out["municipalities"], "municipality", "muni_id", F.size(ring), ring[0]["x"]).unionByName(
        item(out["road_segments"], "road", "osm_id", F.size("pts"), S.start_point(F.col("pts"))["x"])).unionByName(
        item(out["census_tracts"], "tract", "tract_id", F.size(ring), ring[0]["x"])).unionByName(
        item(out["crashes"], "crash", "crash_id", F.when(F.col("crash_date").isNull(), 0).otherwise(1), F.col("longitude")))
