"""Queries: files, documents in JSON, sinks. Files are written from the tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import columns as C
from loamgrid.functions import fixed_values as V
from loamgrid.plans.registry import query
from loamgrid.plans.views import areas, raster_cells, raw_samples, samples, segments, table
from loamgrid.session import scratch_path
from loamgrid.sources import documents as D
from loamgrid.sources import files as S
from loamgrid.sources import sinks as K

r6 = lambda c, n: F.round(c, 6).alias(n)


@query(
    "scan_csv_best_encoding",
    "select sample_id as id, lat, som_text as som, 'gb18030' as enc, ';' as sep from (select s.sample_id, cast(floor(lat * 1000) as bigint) as lat, som_text from samples s join raw_samples r on s.sample_id = r.sample_id)",
    ("raw_samples",),
)
def q_csv(spark, sf):
    s = samples(spark, sf).join(raw_samples(spark, sf), "sample_id")
    path = scratch_path(spark, "csv")
    out = s.select(F.col("sample_id").alias("点号"), F.floor(F.col("lon") * 1000).alias("经度"), F.floor(F.col("lat") * 1000).alias("纬度"), F.col("som_text").alias("土壤有机质"))
    S.allow_all_charsets(spark)
    out.write.csv(path, header=True, sep=";", encoding="GBK")
    df, enc, sep = S.scan_csv_best(spark, path)
    return df.select(F.col("点号").cast("long").alias("id"), F.col("纬度").cast("long").alias("lat"), F.col("土壤有机质").alias("som"), F.lit(enc).alias("enc"), F.lit(sep).alias("sep"))


REST = "utf-8,gb18030,gbk,cp936,big5,cp950,utf-16,utf-16-le,utf-16-be,latin1"


@query(
    "encoding_candidates",
    f"""select doc_id, case doc_id % 3 when 0 then 'utf-8-sig,{REST}' when 1 then 'utf-16,utf-16-le,utf-16-be,utf-8-sig,utf-8,gb18030,gbk,cp936,big5,cp950,latin1' else 'utf-8-sig,{REST}' end as encs from documents""",
)
def q_enc(spark, sf):
    m = F.col("doc_id") % 3
    raw = F.when(m == 0, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8"))).when(m == 1, F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE"))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(",", S.encoding_candidates(raw)).alias("encs"))


@query(
    "csv_parse_score",
    """select p_partkey, case p_partkey % 4 when 0 then 3 * 0.8::double + 120 + 30 + 40 + 3 * least(p_size, 50) * 0.25::double when 1 then 0.8::double + 40 + 40 - 80 - 120 + least(p_size, 50) * 0.25::double when 2 then 4 * 0.8::double + 120 + 30 + 40 + 8 * 2.5::double + 3 * least(p_size, 50) * 0.25::double
else 2 * 0.8::double - 100 - (8 + 2) * 2 end as score from part""",
)
def q_score(spark, sf):
    heads = [["lon", "lat", "som"], ["a,som_value;x"], ["经度", "纬度", "有机质g", "备"], ["ÃÂ", "bb"]]
    k = F.col("p_partkey") % 4
    cols = F.get(F.array(*[F.array(*[F.lit(c) for c in h]) for h in heads]), k.cast("int"))
    enc = F.when(k == 3, "latin1").otherwise("utf-8")
    v = {f: F.col("p_size") for f in V.REQUIRED_FIELDS}
    return table(spark, sf, "part").select("p_partkey", S.csv_parse_score(cols, enc, v).alias("score"))


@query("scan_text_table_simple", "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def q_simple(spark, sf):
    path = scratch_path(spark, "orders-csv")
    table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").write.csv(path, header=True, encoding="UTF-8")
    df = S.read_table_simple(spark, path, schema="o_orderkey bigint, o_orderpriority string, o_totalprice double")
    return df.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("inspect_table_shape", "select least(count(*), 200) as probe_rows, count(*) as all_rows, 6 as columns from part")
def q_shape(spark, sf):
    return S.table_shape(table(spark, sf, "part"))


@query(
    "validate_raster_meta",
    """with m as (select layer, max("col") + 1 as width, max("row") + 1 as height, count("value") as valid from raster_cells group by layer)
select layer, width, height, valid, width > 0 and height > 0 as size_ok, valid = 0 as empty, layer = 'class' as no_nodata from m""",
    ("raster_cells",),
)
def q_meta(spark, sf):
    c = raster_cells(spark, sf)
    meta = c.groupBy("layer").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height")).withColumn("nodata", F.when(F.col("layer") != "class", -9999.0))
    return validate_raster_meta(meta, c)


def validate_raster_meta(meta, cells):
    """Size, nodata and value checks of every layer."""
    n = cells.groupBy("layer").agg(F.count("value").alias("valid"))
    j = meta.join(n, "layer", "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    return j.select("layer", "width", "height", "valid", ((F.col("width") > 0) & (F.col("height") > 0)).alias("size_ok"), (F.col("valid") == 0).alias("empty"), F.col("nodata").isNull().alias("no_nodata"))


@query("scan_files_recursive", "select lang, true as found from documents group by lang")
def q_files(spark, sf):
    path = scratch_path(spark, "docs")
    table(spark, sf, "documents").select("doc_id", "text", "lang").write.partitionBy("lang").parquet(path)
    f = S.list_files(spark, [path], "*.parquet")
    return f.groupBy(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang")).agg((F.sum("length") > 0).alias("found"))


@query(
    "classify_file_header",
    """select doc_id, case doc_id % 9 when 0 then 'html' when 1 then 'zip' when 2 then 'geotiff' when 3 then 'hdf' when 4 then 'netcdf' when 5 then 'table' when 6 then 'geojson' when 7 then 'json_site_resource' else case when octet_length(encode(text)) > 1024 then 'binary' else 'unknown' end end as kind from documents""",
)
def q_class(spark, sf):
    m = F.col("doc_id") % 9
    body = F.encode("text", "UTF-8")
    js = F.encode(F.to_json(F.struct(F.col("doc_id").alias("code"))), "UTF-8")
    geo = F.encode(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("doc_id").alias("n"))), "UTF-8")
    content = (
        F.when(m == 0, F.concat(F.lit(b" <!DOCTYPE html><html>"), body)).when(m == 1, F.concat(F.lit(b"PK\x03\x04"), body)).when(m == 2, F.concat(F.lit(b"II*\x00"), body))
        .when(m == 3, F.concat(F.lit(b"\x89HDF"), body)).when(m == 4, F.concat(F.lit(b"CDF\x01"), body)).when(m == 6, geo).when(m == 7, js).otherwise(body)
    )
    path = F.concat(F.lit("/d/"), F.col("doc_id").cast("string"), F.when(m == 5, ".csv").when(m.isin(6, 7), ".json").otherwise(".bin"))
    ct = F.when(m == 8, "application/octet-stream").otherwise("")
    return table(spark, sf, "documents").select("doc_id", S.classify_header(path, content, ct).alias("kind"))


@query(
    "validate_downloaded_files",
    """with f as (select doc_id, n_chars * 40 as size, case doc_id % 5 when 0 then '.html' when 1 then '.dat' else '.tif' end as ext, doc_id % 7 = 0 as web from documents)
select case when ext = '.html' then 'web_or_preview_file' when size < 10240 then 'too_small' when ext = '.dat' then 'unsupported_extension' when web then 'html_or_web_content' else 'accepted' end as verdict, count(*) as n from f group by 1""",
)
def q_valid(spark, sf):
    k = F.col("doc_id")
    ext = F.when(k % 5 == 0, ".html").when(k % 5 == 1, ".dat").otherwise(".tif")
    head = F.when(k % 7 == 0, F.encode(F.concat(F.lit("<HTML>"), "text"), "UTF-8")).otherwise(F.lit(b"II*\x00"))
    d = table(spark, sf, "documents").select(S.download_verdict(F.concat(F.lit("/d/f"), ext), F.col("n_chars") * 40, head).alias("verdict"))
    return d.groupBy("verdict").agg(F.count("*").alias("n"))


def _overpass(spark, sf):
    """One map-feature document per supplier group, built from the segments."""
    s = segments(spark, sf)
    pts = F.array(F.struct((F.col("x1") / 1000).alias("lon"), (F.col("y1") / 1000).alias("lat")), F.struct((F.col("x2") / 1000).alias("lon"), (F.col("y2") / 1000).alias("lat")))
    k = F.col("seg_id")
    tags = F.when(k % 3 == 0, F.create_map(F.lit("highway"), F.lit("primary"))).when(k % 3 == 1, F.create_map(F.lit("natural"), F.lit("water"))).otherwise(F.create_map(F.lit("name"), F.lit("x")))
    el = F.struct(F.when(k % 5 == 4, "node").otherwise("way").alias("type"), k.alias("id"), tags.alias("tags"), F.when(k % 7 == 0, F.slice(pts, 1, 1)).otherwise(pts).alias("geometry"))
    return s.select(F.to_json(F.struct(F.array(el).alias("elements"))).alias("doc"))


@query(
    "scan_overpass_json",
    "select seg_id as id, case seg_id % 3 when 0 then 'road' else 'water' end as kind, round(x1 / 1000, 6) as x1, round(y2 / 1000, 6) as y2 from segments where seg_id % 3 < 2 and seg_id % 5 <> 4 and seg_id % 7 <> 0",
    ("segments",),
)
def q_overpass(spark, sf):
    l = D.overpass_lines(_overpass(spark, sf), "doc")
    return l.select("id", "kind", F.inline("segments")).select("id", "kind", r6("x1", "x1"), r6("y2", "y2"))


@query(
    "scan_granule_links",
    "select p_partkey, 'https://h/' || p_partkey || '.hdf' as href from part union all select p_partkey, 'https://h/get?id=' || p_partkey from part where p_partkey % 2 = 0",
)
def q_granules(spark, sf):
    k = F.col("p_partkey").cast("string")
    link = lambda href, rel, title, inh=False: F.struct(href.alias("href"), F.lit(rel).alias("rel"), F.lit(title).alias("title"), F.lit(inh).alias("inherited"))
    hdf = F.concat(F.lit("https://h/"), k, F.lit(".hdf"))
    get = F.concat(F.lit("https://h/get?id="), k)
    links = F.array(
        link(hdf, "http://x/data#", ""), link(hdf, "", "again"), link(F.concat(F.lit("https://h/"), k, F.lit(".png")), "browse#", "Data"), link(F.concat(hdf, F.lit("x")), "data#", "", True)
    )
    links = F.when(F.col("p_partkey") % 2 == 0, F.concat(links, F.array(link(get, "", "Download it")))).otherwise(links)
    docs = table(spark, sf, "part").select("p_partkey", F.to_json(F.array(F.struct(links.alias("links")))).alias("doc"))
    return D.granule_links(docs, "doc", ["p_partkey"])


@query(
    "load_band_map",
    """with p as (select p_partkey, p_name, p_type, p_partkey % 6 as m, regexp_replace(p_name, '\\s+', '_', 'g') as a, regexp_replace(p_type, '\\s+', '_', 'g') as b from part)
select p_partkey, 1 as band, case when m < 4 then a when m = 4 and p_partkey % 4 = 0 then a else 'stack_band_01' end as feature, case when m < 4 then 'companion_mapping_file' when m = 4 and p_partkey % 4 = 0 then 'band_description' else 'fallback_band_index_names' end as source from p
union all select p_partkey, 2, case when m < 4 then b else 'stack_band_02' end, case when m < 4 then 'companion_mapping_file' when m = 4 and p_partkey % 4 = 0 then 'band_description' else 'fallback_band_index_names' end from p""",
)
def q_bands(spark, sf):
    """Maps as a list, a mapping, names alone and a table; two files in six hold none, some of them with a description."""
    m = F.col("p_partkey") % 6
    listed = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("band"), F.col("p_name").alias("feature_name")), F.struct(F.lit(2).alias("band"), F.col("p_type").alias("feature_name"))).alias("bands")))
    mapped = F.to_json(F.create_map(F.lit("1"), F.col("p_name"), F.lit("2"), F.col("p_type")))
    plain = F.to_json(F.array("p_name", "p_type"))
    csv = F.concat(F.lit("Variable,Band_Index\n"), "p_type", F.lit(",2\n"), "p_name", F.lit(",1\n"))
    doc = F.when(m == 0, listed).when(m == 1, mapped).when(m == 2, plain)
    found = F.when(m == 3, D.band_table(csv)).otherwise(F.coalesce(D.band_map(doc), F.array().cast("array<struct<band:int,feature:string>>")))
    p = table(spark, sf, "part").withColumn("m", found).withColumn("described", F.when((m == 4) & (F.col("p_partkey") % 4 == 0), F.array("p_name")).otherwise(F.array().cast("array<string>")))
    named = D.band_names(p, F.lit(2), F.col("m"), F.col("described"), F.lit("stack"))
    return named.select("p_partkey", "band", F.col("name").alias("feature"), "source")


@query(
    "choose_sample_file",
    """with f as (select user_id, event_id, '/u/' || event_id || case when event_id % 97 = 0 then '_cleaned' else '' end || case event_type when 'view' then '.csv' when 'click' then '.xlsx' when 'signup' then '.xls' when 'purchase' then '.tif' else '.md' end as path, case when event_id % 11 = 0 then 'sample_points' else 'other' end as role,
 case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 when 'purchase' then 4 else 0 end as s from events)
select user_id, path, event_id from (select *, row_number() over (partition by user_id order by case when contains(path, 'cleaned') then 0 when role = 'sample_points' then 1 else 2 end, s, event_id desc) as rn from f where s > 0) where rn = 1""",
)
def q_choose(spark, sf):
    t, k = F.col("event_type"), F.col("event_id")
    ext = F.when(t == "view", ".csv").when(t == "click", ".xlsx").when(t == "signup", ".xls").when(t == "purchase", ".tif").otherwise(".md")
    path = F.concat(F.lit("/u/"), k.cast("string"), F.when(k % 97 == 0, "_cleaned").otherwise(""), ext)
    f = table(spark, sf, "events").select("user_id", k, path.alias("path"), F.when(k % 11 == 0, "sample_points").otherwise("other").alias("role"))
    return S.choose_sample_file(f, "user_id", "event_id")


@query(
    "load_admin_polygons",
    "select a.area_id, a.name, round(e.x1, 6) as x1, round(e.y1, 6) as y1, round(e.x2, 6) as x2, round(e.y2, 6) as y2, n from areas a join area_edges e on a.area_id = e.area_id join (select c_nationkey, count(*) as n from customer group by 1) c on c_nationkey = a.area_id",
    ("areas", "area_edges"),
)
def q_polys(spark, sf):
    a = areas(spark, sf)
    ring = F.transform("edges", lambda e: F.array(e["x1"], e["y1"]))
    feat = F.struct(
        F.create_map(F.lit("id"), F.col("area_id").cast("string"), F.lit("NAME_2"), F.col("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    docs = a.select(F.to_json(F.struct(F.array(feat).alias("features"))).alias("doc"))
    g = D.geojson_areas(docs, "doc", ["NAME_3", "NAME_2", "NAME_1"])
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("area_id")).agg(F.count("*").alias("n"))
    return g.join(n, "area_id").select("area_id", "name", "n", F.inline("edges")).select("area_id", "name", "n", *[r6(c, c) for c in ("x1", "y1", "x2", "y2")])


@query("raster_cells_source", """select "row", "col", case when "value" > 25 then null else "value" end as "value" from raster_cells where layer = 'qty'""", ("raster_cells",))
def q_rsource(spark, sf):
    path = scratch_path(spark, "cells")
    c = raster_cells(spark, sf).withColumn("value", F.when((F.col("layer") == "qty") & (F.col("value") > 25), None).otherwise(F.col("value")))
    K.write_raster_cells(c, path)
    return K.read_raster_cells(spark, path).filter("layer = 'qty'").select("row", "col", "value")


@query(
    "read_manifest_json",
    "select p_partkey, p_brand as target, case when p_partkey % 2 = 0 then p_size end as r2 from part",
)
def q_manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    p = table(spark, sf, "part")
    even = F.col("p_partkey") % 2 == 0
    doc = p.select("p_partkey", F.to_json(F.struct(F.when(even, F.struct(F.col("p_brand").alias("target"), F.struct(F.col("p_size").alias("r2")).alias("metrics"))).alias("report"), F.when(~even, F.col("p_brand")).alias("target"))).alias("doc"))
    K.write_json_report(doc, path)
    d = spark.read.schema("p_partkey bigint, doc string").json(path)
    return d.select("p_partkey", D.manifest_field(F.col("doc"), "$.target", "$.report.target").alias("target"), D.manifest_field(F.col("doc"), "$.metrics.r2", "$.report.metrics.r2").cast("int").alias("r2"))


@query("sink_table", "select l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem group by 1")
def q_sink(spark, sf):
    path = scratch_path(spark, "table")
    K.write_table(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice"), path)
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query(
    "sink_raster_cells",
    """select layer, count(*) as n, count(*) filter ("value" is null) as missing, min(coalesce("value", -9999)) as mn from (select layer, case when "row" = 3 then null else "value" end as "value" from raster_cells) group by layer""",
    ("raster_cells",),
)
def q_sinkr(spark, sf):
    path = scratch_path(spark, "raster")
    K.write_raster_cells(raster_cells(spark, sf).withColumn("value", F.when(F.col("row") == 3, None).otherwise(F.col("value"))), path)
    c = spark.read.parquet(path)
    return c.groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.col("value") == K.NODATA).alias("missing"), F.min("value").alias("mn"))


@query("sink_json_report", "select p_brand, count(*) as n, max(p_size) as top from part group by 1")
def q_sinkj(spark, sf):
    path = scratch_path(spark, "report")
    rep = table(spark, sf, "part").groupBy("p_brand").agg(F.struct(F.count("*").alias("n"), F.max("p_size").alias("top")).alias("stats"))
    K.write_json_report(rep, path)
    return spark.read.schema("p_brand string, stats struct<n:bigint,top:int>").json(path).select("p_brand", "stats.*")


@query("sink_append_log", "select event_type, count(*) * 2 as n, max(event_id) as last from events group by 1")
def q_sinkl(spark, sf):
    path = scratch_path(spark, "log")
    e = table(spark, sf, "events").select("event_id", "event_type")
    K.append_log(e, path)
    K.append_log(e, path)
    return spark.read.schema("event_id bigint, event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
