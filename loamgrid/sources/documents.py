"""JSON sources: map features, granule links, band maps, areas and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.functions import fixed_values as V
from loamgrid.operators.raster import edges_of_ring

OVERPASS = "elements array<struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>>>"
GRANULES = "array<struct<links:array<struct<href:string,rel:string,title:string,inherited:boolean>>>>"


def overpass_lines(df: DataFrame, text: str) -> DataFrame:
    """(id, kind, vertices, segments) of road and water ways with at least two vertices."""
    e = df.select(F.inline(F.from_json(text, f"struct<{OVERPASS.replace('elements ', 'elements:', 1)}>")["elements"]))
    pts = F.filter("geometry", lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    ways = e.filter((F.col("type") == "way") & (F.size(pts) >= 2)).withColumn("pts", pts)
    road = F.col("tags").getItem("highway").isNotNull()
    water = F.col("tags").getItem("waterway").isNotNull() | (F.col("tags").getItem("natural") == "water")
    kinds = F.array_compact(F.array(F.when(road, "road"), F.when(water, "water")))
    seg = F.transform(
        F.sequence(F.lit(0), F.size("pts") - 2),
        lambda i: F.named_struct(
            F.lit("x1"), F.get("pts", i)["lon"], F.lit("y1"), F.get("pts", i)["lat"], F.lit("x2"), F.get("pts", i + 1)["lon"], F.lit("y2"), F.get("pts", i + 1)["lat"]
        ),
    )
    return ways.select("id", F.explode(kinds).alias("kind"), F.size("pts").alias("vertices"), seg.alias("segments"))


def granule_links(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Data links per input row, first occurrence of an address only; inherited and browse links drop out."""
    g = df.select(*keep, F.posexplode(F.from_json(text, GRANULES)).alias("g", "e")).select(*keep, "g", F.posexplode("e.links").alias("l", "k"))
    g = g.select(*keep, "g", "l", "k.*")
    ext = F.regexp_extract(F.lower(F.regexp_replace("href", r"[?#].*$", "")), r"(\.[^./]*)$", 1)
    rel, title = F.lower(F.coalesce("rel", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    data = ext.isin(".hdf", ".h5", ".hdf5", ".nc", ".tif", ".tiff") | rel.contains("data#") | title.rlike("download|data")
    browse = rel.contains("browse") | title.contains("browse") | ext.isin(".jpg", ".jpeg", ".png")
    ok = g.filter((F.col("href") != "") & ~F.coalesce("inherited", F.lit(False)) & data & ~browse)
    first = ok.groupBy(*keep, "href").agg(F.min(F.struct("g", "l")).alias("pos"))
    return first.select(*keep, "href")


def band_map(text: Column) -> Column:
    """array<struct<band, feature>> from a list document, a map document or a plain list of names."""
    row = "struct<band:int,feature_name:string,name:string,feature:string,variable:string,covariate:string>"
    rows = F.from_json(text, f"struct<bands:array<{row}>>")["bands"]
    listed = F.transform(
        rows, lambda r: F.struct(r["band"].alias("band"), F.trim(F.coalesce(r["feature_name"], r["name"], r["feature"], r["variable"], r["covariate"])).alias("feature"))
    )
    mapped = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(F.trim(e["key"]).try_cast("int").alias("band"), F.trim(e["value"]).alias("feature")))
    names = F.from_json(text, "array<string>")
    plain = F.transform(names, lambda v, i: F.struct((i + 1).alias("band"), F.trim(v).alias("feature")))
    out = F.when(rows.isNotNull(), listed).when(F.ltrim(text).startswith("["), plain).otherwise(mapped)
    return F.filter(out, lambda b: (b["band"] >= 1) & (b["feature"] != ""))


def band_table(text: Column) -> Column:
    """The same from a delimited table: a band and a name column found by their headers, or a single column of names.

    Empty lines do not count; rows without a number above 0 or without a name go; a table without these columns is empty.
    """
    lines = F.filter(F.split(F.regexp_replace(text, "^\ufeff", ""), r"\r\n|\r|\n"), lambda l: F.trim(l) != "")
    cells = F.transform(lines, lambda l: F.transform(F.split(l, ","), lambda c: F.trim(c)))
    head = F.transform(F.get(cells, F.lit(0)), lambda c: F.lower(c))
    at = lambda names: F.get(F.filter(F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.array_position(head, n)), lambda i: i > 0), F.lit(0)).cast("int") - 1
    band, name = at(V.BAND_HEADERS), at(V.BAND_NAME_HEADERS)
    rows = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    table = F.transform(rows, lambda r: F.struct(F.get(r, band).try_cast("int").alias("band"), F.get(r, name).alias("feature")))
    single = F.transform(rows, lambda r, i: F.struct((i + 1).alias("band"), F.get(r, F.lit(0)).alias("feature")))
    empty = F.array().cast("array<struct<band:int,feature:string>>")
    out = F.when(band.isNotNull() & name.isNotNull(), table).when(F.size(head) == 1, single).otherwise(empty)
    return F.when(text.isNotNull(), F.filter(F.coalesce(out, empty), lambda b: (b["band"] >= 1) & (b["feature"] != "")))


def band_names(df: DataFrame, count: Column, mapped: Column, described: Column, stem: Column) -> DataFrame:
    """Name of every band: companion map, else descriptions, else stem and number; and where they came from."""
    src = F.when(F.size(mapped) > 0, "companion_mapping_file").when(F.exists(described, lambda d: F.trim(d) != ""), "band_description").otherwise("fallback_band_index_names")
    number = lambda i: F.concat(stem, F.lit("_band_"), F.lpad(i.cast("string"), 2, "0"))

    def name(i):
        own = F.get(F.filter(mapped, lambda b: b["band"] == i), F.lit(0))["feature"]
        desc = F.nullif(F.trim(F.get(described, i - 1)), F.lit(""))
        return F.coalesce(F.when(F.size(mapped) > 0, own).otherwise(desc), number(i))

    d = df.withColumn("source", src).select("*", F.explode(F.sequence(F.lit(1), count)).alias("band"))
    return d.withColumn("name", F.regexp_replace(name(F.col("band")), r"\s+", "_"))


def geojson_areas(df: DataFrame, text: str, name_fields: list[str]) -> DataFrame:
    """(area_id, name, edges) of polygon features; the first name field with a value wins."""
    f = f"struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>>"
    e = df.select(F.inline(F.from_json(text, f)["features"])).filter(F.col("geometry.type") == "Polygon")
    name = F.coalesce(*[F.col("properties").getItem(k) for k in name_fields])
    ring = F.transform(F.get("geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return e.select(F.col("properties").getItem("id").try_cast("int").alias("area_id"), name.alias("name"), edges_of_ring(ring).alias("edges"))


def manifest_field(text: Column, *paths: str) -> Column:
    """First value found under the given JSON paths."""
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])
