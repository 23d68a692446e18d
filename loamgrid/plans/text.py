"""Queries: request text, file names, web pages, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamgrid.functions import columns as C
from loamgrid.functions import fixed_values as V
from loamgrid.functions import html as H
from loamgrid.functions import text as X
from loamgrid.operators.aggregates import last_n
from loamgrid.operators.ordering import running
from loamgrid.operators.chat import conversation_summary, conversation_title, dedupe_recent
from loamgrid.operators import rules
from loamgrid.plans.registry import query
from loamgrid.plans.views import spread, table

r6 = lambda c, n: F.round(c, 6).alias(n)

PIECES = [
    ("k % 4", ["请下载", "绘制", "生成", "获取"]),
    ("k % 5", ["2021年", "20220年", "1995年", "", "2016年"]),
    ("k % 3", ["成都市", "四川省", "双流区"]),
    ("k % 6", ["耕地", "林地", "草地", "湿地", "", "全域"]),
    ("0", ["土壤有机质图"]),
    ("k % 4", ["，分辨率250米", "，分辨率为1km", "，500m 和 30m 数据", ""]),
    ("k % 7", ["，EPSG:4490", "，坐标系 32648", "，WGS84", "，CGCS2000 Albers", "", "", ""]),
    ("k % 8", ["，以 DEM 为基准", "，对齐到 slope_250m.tif", "", "", "", "", "", ""]),
    ("k % 9", ["，使用NDVI", "，使用降水", "", "", "", "", "", "", ""]),
]


def _sql_text() -> str:
    parts = []
    for sel, opts in PIECES:
        sel = sel.replace("k", "p_partkey")
        parts.append("case " + sel + " " + " ".join(f"when {i} then '{o}'" for i, o in enumerate(opts)) + " end")
    return "concat(" + ", ".join(parts) + ", '，n_estimators=' || cast(p_size * 100 as varchar) || ' 最大深度' || cast(p_size as varchar))"


REQ = f"req as (select p_partkey, p_size, {_sql_text()} as t from part)"


def requests(spark, sf):
    """Request texts composed from the part table."""
    k = F.col("p_partkey")
    cols = []
    for sel, opts in PIECES:
        arr = F.array(*[F.lit(o) for o in opts])
        idx = F.lit(0) if sel == "0" else (k % int(sel.split("%")[1])).cast("int")
        cols.append(F.get(arr, idx))
    size = F.col("p_size")
    tail = F.concat(F.lit("，n_estimators="), (size * 100).cast("string"), F.lit(" 最大深度"), size.cast("string"))
    return spread(table(spark, sf, "part").select(k, size)).select(k, size, F.concat(*cols, tail).alias("t"))


def _pick(sel: str, vals: list[str]) -> str:
    return "case " + sel.replace("k", "p_partkey") + " " + " ".join(f"when {i} then {v}" for i, v in enumerate(vals)) + " end"


# A number such as the 2000 in a datum name or a parameter reads as a year when nothing before it does.
YEAR_SQL = _pick("k % 5", ["2021", "2020", "1995", "case when p_partkey % 7 = 3 then 2000 when p_size in (19, 20) then p_size * 100 end", "2016"])
RES_SQL = _pick("k % 4", ["250.0::double", "1000.0::double", "500.0::double", "null::double"])
# Without a year only download verbs are cut off before the place.
REGION_SQL = "case when p_partkey % 5 = 3 and p_partkey % 4 = 1 then '绘制' when p_partkey % 5 = 3 and p_partkey % 4 = 2 then '生成' else '' end || " + _pick("k % 3", ["'成都市'", "'四川省'", "'双流区'"])
CRS_SQL = _pick("k % 7", ["'EPSG:4490'", "'EPSG:32648'", "'EPSG:4326'", "'albers_cgcs2000'", "null", "null", "null"])
REF_SQL = _pick("k % 8", ["'DEM'", "'slope_250m.tif'", "null", "null", "null", "null", "null", "null"])
SCOPE_SQL = _pick("k % 6", ["1", "2", "4", "5", "null", "null"])
# A layer named as reference also names the data set.
DATA_SQL = "case when p_partkey % 9 = 1 then '降水' when p_partkey % 9 = 0 then 'NDVI' when p_partkey % 8 = 0 then 'DEM' else '土壤' end"


def _req_query(name, sql, fn):
    @query(name, f"with {REQ} select p_partkey, {sql} as v from req")
    def run(spark, sf):
        return requests(spark, sf).select("p_partkey", fn(F.col("t")).alias("v"))

    return run


_req_query("parse_year", YEAR_SQL, X.parse_year)
_req_query("parse_resolution", RES_SQL, X.parse_resolution)
_req_query("parse_region", REGION_SQL, X.parse_region)
_req_query("parse_crs", CRS_SQL, X.parse_crs)
_req_query("parse_reference_name", REF_SQL, X.parse_reference_name)
_req_query("parse_landcover_scope", SCOPE_SQL, X.parse_landcover_scope)
_req_query("parse_data_name", DATA_SQL, X.parse_data_name)


@query(
    "parse_model_params",
    f"with {REQ} select p_partkey, least(greatest(p_size * 100, 50), 3000)::double as n_estimators, least(greatest(p_size, 2), 80)::double as max_depth from req",
)
def q_params(spark, sf):
    return requests(spark, sf).select("p_partkey", X.parse_model_params(F.col("t")).alias("p")).select("p_partkey", "p.n_estimators", "p.max_depth")


@query(
    "request_spec",
    f"""with {REQ} select p_partkey, {YEAR_SQL} as year, {REGION_SQL} as region, {RES_SQL} as resolution_m, {CRS_SQL} as crs, {REF_SQL} as reference, {SCOPE_SQL} as class_code,
case when p_partkey % 6 = 0 then 'cropland' when p_partkey % 6 < 4 then 'landcover_class' else 'full_domain' end as map_scope, {DATA_SQL} as data_name from req""",
)
def q_spec(spark, sf):
    return requests(spark, sf).select("p_partkey", X.request_spec(F.col("t")).alias("s")).select("p_partkey", "s.*")


@query(
    "normalize_text",
    r"""select doc_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(replace(text, '　', ' '), '\s+', ' ', 'g')), '[，,。；;]{2,}', '，', 'g'), '\s+', ' ', 'g')) as t from documents""",
)
def q_norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("t"))


def _score_sql(words):
    return " + ".join(f"case when contains(lower(text), '{w}') then 1 else 0 end" for w in words)


@query(
    "infer_domain",
    f"with s as (select doc_id, {_score_sql(V.SOIL_TERMS)} as s, {_score_sql(V.CAR_TERMS)} as a from documents) select doc_id, case when s = 0 and a = 0 then 'unknown' when s >= a then 'soil_dsm' else 'auto_dsm' end as domain from s",
)
def q_domain(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.infer_domain(F.col("text")).alias("domain"))


def _latin_sql():
    return rf"""(length(text) - length(regexp_replace(text, '[{V.MOJIBAKE}]', '', 'g'))) * 8.0::double + (length(text) - length(regexp_replace(text, '[\x{{00A0}}-\x{{00FF}}]', '', 'g'))) * 2.0::double + (length(text) - length(replace(text, '�', ''))) * 20.0::double"""


@query("mojibake_penalty", f"select doc_id, {_latin_sql()} as penalty from documents")
def q_moji(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.mojibake_penalty(F.col("text")).alias("penalty"))


SUFCASE = "case " + " ".join(f"when ends_with(n, '{s}') and length(n) > {len(s)} then left(n, length(n) - {len(s)})" for s in V.ADMIN_SUFFIXES) + " else n end"


@query(
    "strip_admin_suffix",
    f"with n as (select c_custkey, c_mktsegment || case c_custkey % 5 when 0 then '市' when 1 then '自治州' when 2 then '回族自治区' when 3 then '县' else '' end as n from customer) select c_custkey, {SUFCASE} as n from n",
)
def q_suffix(spark, sf):
    m = F.col("c_custkey") % 5
    n = F.concat("c_mktsegment", F.when(m == 0, "市").when(m == 1, "自治州").when(m == 2, "回族自治区").when(m == 3, "县").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", X.strip_admin_suffix(n).alias("n"))


@query(
    "safe_name",
    r"""with n as (select doc_id, left(trim(regexp_replace(text, '[^0-9A-Za-z一-鿿._-]+', '_', 'g'), '._-'), 80) as n, case when doc_id % 3 = 0 then 'con.txt' else 'a:b?/x' || doc_id || '*.csv' end as f from documents)
select doc_id, case when n = '' then 'x' else n end as n, case when doc_id % 3 = 0 then '_con.txt' else 'x' || doc_id || '_.csv' end as f from n""",
)
def q_safe(spark, sf):
    f = F.when(F.col("doc_id") % 3 == 0, "con.txt").otherwise(F.concat(F.lit("a:b?/x"), F.col("doc_id").cast("string"), F.lit("*.csv")))
    return table(spark, sf, "documents").select("doc_id", X.safe_name(F.col("text")).alias("n"), X.safe_filename(f).alias("f"))


@query(
    "year_from_filename",
    "select o_orderkey, case when o_orderkey % 4 = 3 then null else 1995 + o_orderkey % 30 end as year from orders",
)
def q_fyear(spark, sf):
    k = F.col("o_orderkey")
    y = (F.lit(1995) + k % 30).cast("string")
    path = F.concat(F.lit("/in/1999/soil_"), F.when(k % 4 == 3, "20220516").otherwise(y), F.lit("_v2.csv"))
    return table(spark, sf, "orders").select("o_orderkey", C.year_from_filename(path).cast("long").alias("year"))


@query(
    "file_role",
    """with f as (select p_partkey, p_size, case p_partkey % 8 when 0 then 'points.csv' when 1 then 'obs_ndvi.csv' when 2 then 'Cropland_mask.tif' when 3 then 'CLCD_2020.tif' when 4 then 'bulk_density.tif' when 5 then 'county_boundary.shp' when 6 then 'precip.nc' else 'pack.zip' end as name from part)
select p_partkey, case p_partkey % 8 when 0 then 'sample_points' when 1 then 'covariate_table_points' when 2 then 'mask_raster' when 3 then 'covariate_categorical' when 4 then 'covariate_raster' when 5 then 'admin_boundary' when 6 then 'multidimensional_covariate' else 'archive_package' end as role,
case p_partkey % 8 when 0 then 0.96::double when 1 then 0.72::double when 2 then 0.88::double when 3 then 0.92::double when 4 then 0.92::double when 5 then 0.82::double when 6 then 0.76::double else 0.6::double end as confidence,
case p_partkey % 8 when 1 then 'VegPhenology' when 3 then 'CLCD' when 4 then 'BD' when 6 then 'SeasonalClimateWater' end as covariate from f""",
)
def q_frole(spark, sf):
    k = F.col("p_partkey") % 8
    names = ["points.csv", "obs_ndvi.csv", "Cropland_mask.tif", "CLCD_2020.tif", "bulk_density.tif", "county_boundary.shp", "precip.nc", "pack.zip"]
    path = F.concat(F.lit("/up/"), F.get(F.array(*[F.lit(n) for n in names]), k.cast("int")))
    return table(spark, sf, "part").select("p_partkey", X.file_role(path, F.lit(True), F.lit(True), k == 0).alias("r")).select("p_partkey", "r.role", "r.confidence", "r.covariate")


@query(
    "resolution_to_metres",
    "select s_suppkey, round(case when s_suppkey % 2 = 0 then greatest(0.002::double * 111320.0::double * greatest(0.2::double, cos(radians(s_acctbal / 200))), 0.0019::double * 111320.0::double) else greatest(30 + s_suppkey % 5, 30 + s_suppkey % 7)::double end, 6) as m from supplier",
)
def q_metres(spark, sf):
    k = F.col("s_suppkey")
    geo = k % 2 == 0
    rx = F.when(geo, 0.002).otherwise((30 + k % 5).cast("double"))
    ry = F.when(geo, -0.0019).otherwise(-(30 + k % 7).cast("double"))
    return table(spark, sf, "supplier").select("s_suppkey", r6(C.resolution_to_metres(rx, ry, F.col("s_acctbal") / 200, geo), "m"))


@query(
    "year_source_decision",
    "select o_orderkey, case when o_orderkey % 3 = 0 then 2020 when o_orderkey % 2 = 0 then 2018 when o_orderkey % 5 = 0 then 2015 end as year, case when o_orderkey % 3 = 0 then 'request' when o_orderkey % 2 = 0 then 'filename' when o_orderkey % 5 = 0 then 'table' else 'none' end as source, o_orderkey % 3 = 0 and o_orderkey % 2 = 0 as mismatch from orders",
)
def q_ysource(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda m, y: F.when(k % m == 0, F.lit(y))
    return table(spark, sf, "orders").select("o_orderkey", year_decision(pick(3, 2020), pick(2, 2018), pick(5, 2015)).alias("d")).select("o_orderkey", "d.*")


def year_decision(request, filename, tab):
    """Request, then file name, then table; a difference between request and file name is noted."""
    src = F.when(request.isNotNull(), "request").when(filename.isNotNull(), "filename").when(tab.isNotNull(), "table").otherwise("none")
    return F.struct(F.coalesce(request, filename, tab).alias("year"), src.alias("source"), F.coalesce(request != filename, F.lit(False)).alias("mismatch"))


@query(
    "spatial_query_scales",
    "select c_custkey, case when c_custkey % 2 = 0 then n_name || '市|' || r_name || '|全国|中国' else '中国' end as scales from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
)
def q_scales(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    reg = F.when(F.col("c_custkey") % 2 == 0, F.concat("n_name", F.lit("市")))
    par = F.when(F.col("c_custkey") % 2 == 0, F.array("r_name"))
    return c.select("c_custkey", F.concat_ws("|", X.spatial_scales(reg, par)).alias("scales"))


@query(
    "product_score",
    "select p_type, p_partkey, score from (select p_type, p_partkey, 100 - p_size + case when contains(p_name, 'bolt') then 50 else 0 end + case when p_brand = 'Brand#7' then 100 else 0 end as score, row_number() over (partition by p_type order by 100 - p_size + case when contains(p_name, 'bolt') then 50 else 0 end + case when p_brand = 'Brand#7' then 100 else 0 end desc, p_partkey) as rn from part) where rn = 1",
)
def q_product(spark, sf):
    score = rules.product_score(F.col("p_size"), (F.contains("p_name", F.lit("bolt")), 50), (F.col("p_brand") == "Brand#7", 100))
    return rules.best_product(table(spark, sf, "part"), ["p_type"], score, "p_partkey")


# ---------------------------------------------------------------- pages

ANCH = r"""an as (select page_id, url, unnest(regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) as href, unnest(regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) as label from pages),
lk as (select page_id, trim(regexp_replace(regexp_replace(label, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text,
case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.\-]*:') then href when starts_with(href, '//') then regexp_extract(url, '^(https?:)', 1) || href when starts_with(href, '/') then regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
 else regexp_extract(url, '^(https?://[^/?#]+)', 1) || case when regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^(.*/)', 1) end || href end as link from an where not regexp_matches(href, '^(javascript:|#|mailto:)'))"""


@query("extract_links", f"with {ANCH} select page_id, text, link, count(*) as n from lk group by 1, 2, 3")
def q_links(spark, sf):
    return H.extract_links(table(spark, sf, "pages")).groupBy("page_id", "text", "link").agg(F.count("*").alias("n"))


# Pages in the tables carry inline scripts only, so each page's own address is added as one.
@query(
    "extract_script_urls",
    "select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/js/app' || (page_id % 5) || '.js' as src from pages",
)
def q_scripts(spark, sf):
    tag = F.concat(F.lit('<script async src="/js/app'), (F.col("page_id") % 5).cast("string"), F.lit('.js"></script>'))
    return H.extract_script_urls(table(spark, sf, "pages").withColumn("html", F.concat(tag, "html", tag)))


# The pages name no data addresses, so each one gets a script with a data path and a file on another host.
@query(
    "extract_url_candidates",
    """select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/api/list?id=' || page_id as link from pages
union all select page_id, 'https://files.example.org/d' || page_id || '.zip' from pages""",
)
def q_cands(spark, sf):
    k = F.col("page_id").cast("string")
    js = F.concat(F.lit("<script>get('/api/list?id="), k, F.lit("'); var u='https://files.example.org/d"), k, F.lit(".zip'; go('https://other.example.org/page')</script>"))
    return H.extract_url_candidates(table(spark, sf, "pages").withColumn("html", F.concat(js, "html")))


URLS = """us as (select page_id, url || case page_id % 6 when 0 then '/a.zip' when 1 then '?f=b.csv' when 2 then '/getFile/9' when 3 then '/view' when 4 then '/export?x=1' else '/data.TIF#p' end as u from pages)"""
FULLSQL = "lower(regexp_replace(regexp_replace(u, '^[a-zA-Z]+://[^/?#]*', ''), '#.*$', ''))"
EXTSQL = "(\\.zip|\\.rar|\\.7z|\\.xls|\\.xlsx|\\.csv|\\.tif|\\.tiff|\\.nc|\\.hdf|\\.h5|\\.hdf5|\\.json|\\.geojson)"


def _urls(spark, sf):
    p = table(spark, sf, "pages")
    tails = ["/a.zip", "?f=b.csv", "/getFile/9", "/view", "/export?x=1", "/data.TIF#p"]
    return p.select("page_id", F.concat("url", F.get(F.array(*[F.lit(t) for t in tails]), (F.col("page_id") % 6).cast("int"))).alias("u"))


@query("is_download_url", f"with {URLS} select page_id, regexp_matches({FULLSQL}, '{EXTSQL}|download|downfile|export|fileid|file_id|attach|attachment|getfile|datafile|下载') as ok from us")
def q_isdl(spark, sf):
    return _urls(spark, sf).select("page_id", H.is_download_url(F.col("u")).alias("ok"))


@query(
    "assess_url",
    f"with {URLS} select page_id, case when regexp_matches(regexp_extract({FULLSQL}, '^([^?]*)', 1), '{EXTSQL}$') then 'direct_file' when regexp_matches({FULLSQL}, '{EXTSQL}') then 'file_in_query' when regexp_matches({FULLSQL}, 'download|downfile|getfile|export|fileid|file_id|attachment') then 'interface' else 'page' end as level from us",
)
def q_assess(spark, sf):
    return _urls(spark, sf).select("page_id", H.assess_url(F.col("u")).alias("level"))


@query("is_candidate_page", "select page_id, regexp_matches(lower(html), 'source|product|dataset|data|search|query|download|api|detail|catalog|资源|产品|数据|下载|检索|详情') as ok from pages")
def q_candp(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.is_candidate_page(F.col("html")).alias("ok"))


@query("filter_year_links", f"with {ANCH} select page_id, link, count(*) as n from lk where contains(link, 'en') or contains(text, 'en') group by 1, 2")
def q_ylinks(spark, sf):
    lk = H.extract_links(table(spark, sf, "pages"))
    return links_naming(lk, "en").groupBy("page_id", "link").agg(F.count("*").alias("n"))


def links_naming(links, year):
    """Links whose address or label names the year."""
    return links.filter(F.contains("link", F.lit(str(year))) | F.contains("text", F.lit(str(year))))


# The pages hold lists and paragraphs, no tables: each page's paragraphs are read as one-column rows.
@query(
    "html_tables",
    r"""with l as (select page_id, unnest(regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1)) as c, unnest(range(0, len(regexp_extract_all(html, '(?is)<li>(.*?)</li>', 1)))) as r from pages)
select page_id, 0 as "table", cast(r as int) as "row", 0 as col, trim(regexp_replace(regexp_replace(c, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as text from l""",
)
def q_tables(spark, sf):
    h = F.regexp_replace(F.regexp_replace("html", "(?is)<li>", "<tr><td>"), "(?is)</li>", "</td></tr>")
    return H.html_tables(table(spark, sf, "pages").withColumn("html", F.concat(F.lit("<table>"), h, F.lit("</table>"))))


# ---------------------------------------------------------------- conversations


@query("recent_history", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn <= 3")
def q_recent(spark, sf):
    return last_n(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role")


@query(
    "conversation_title",
    r"""with u as (select conv_id, turn, trim(regexp_replace(text, '[\r\n]+', ' ', 'g')) as t from conversations where role = 'user' and trim(text) <> ''), f as (select conv_id, arg_min(t, turn) as t from u group by 1)
select c.conv_id, coalesce(case when length(t) > 22 then left(t, 21) || '…' else t end, '新对话') as title from (select distinct conv_id from conversations) c left join f on c.conv_id = f.conv_id""",
)
def q_title(spark, sf):
    return conversation_title(table(spark, sf, "conversations"))


@query(
    "conversation_summary",
    r"""with c as (select conv_id, turn, role, trim(regexp_replace(text, '[\r\n]+', ' ', 'g')) as t from conversations where text <> ''), u as (select conv_id, arg_max(t, turn) as t from c where role = 'user' group by 1), a as (select conv_id, arg_max(t, turn) as t from c where role = 'assistant' group by 1)
select i.conv_id, case when length(u.t) > 28 then left(u.t, 27) || '…' else u.t end as user_tail, case when length(a.t) > 40 then left(a.t, 39) || '…' else a.t end as assistant_tail from (select distinct conv_id from conversations) i left join u on i.conv_id = u.conv_id left join a on i.conv_id = a.conv_id""",
)
def q_summary(spark, sf):
    return conversation_summary(table(spark, sf, "conversations"))


# Every assistant turn is followed by a copy of itself, so repeats occur within the window.
@query(
    "dedupe_recent_messages",
    """select conv_id, turn * 2 as turn, role from conversations c where role <> 'assistant' or not exists (select 1 from conversations d where d.conv_id = c.conv_id and d.role = 'assistant' and d.turn < c.turn and d.turn >= c.turn - 10 and regexp_replace(trim(d.text), '\\s+', ' ', 'g') = regexp_replace(trim(c.text), '\\s+', ' ', 'g'))
union all select conv_id, turn * 2 + 1, role from conversations where role <> 'assistant'""",
)
def q_dedupe(spark, sf):
    c = table(spark, sf, "conversations")
    d = c.select("conv_id", F.explode(F.array(F.col("turn") * 2, F.col("turn") * 2 + 1)).alias("turn"), "role", "text")
    return dedupe_recent(d, "conv_id", "turn").select("conv_id", "turn", "role")


# ---------------------------------------------------------------- progress


LOGSQL = """lg as (select user_id as task, event_id, ts, case event_type when 'view' then 'Clean RFK 候选参数 ' || (event_id % 24 + 1) || '/24 完成' when 'click' then '样点CSV读取成功' when 'signup' then '正式制图流程启动' when 'purchase' then '可出图特征RFK候选参数 ' || (event_id % 24 + 1) || '/24 完成' else 'noise' end as line,
case event_type when 'view' then 55 + cast(floor(17 * (event_id % 24 + 1) / 24.0::double) as int) when 'click' then 10 when 'signup' then 16 when 'purchase' then 72 + cast(floor(8 * (event_id % 24 + 1) / 24.0::double) as int) end as p from events)"""


def logs(spark, sf):
    e = table(spark, sf, "events")
    i = (F.col("event_id") % 24 + 1).cast("string")
    t = F.col("event_type")
    line = (
        F.when(t == "view", F.concat(F.lit("Clean RFK 候选参数 "), i, F.lit("/24 完成")))
        .when(t == "click", "样点CSV读取成功")
        .when(t == "signup", "正式制图流程启动")
        .when(t == "purchase", F.concat(F.lit("可出图特征RFK候选参数 "), i, F.lit("/24 完成")))
        .otherwise("noise")
    )
    return e.select(F.col("user_id").alias("task"), "event_id", "ts", line.alias("line"))


@query(
    "running_progress",
    f"with {LOGSQL} select task, event_id, least(coalesce(max(p) over (partition by task order by ts, event_id rows between unbounded preceding and current row), 0), 99) as progress from lg",
)
def q_progress(spark, sf):
    r = running(logs(spark, sf), ["task"], ["ts", "event_id"], X.progress_of(F.col("line")), "max", "top")
    return r.select("task", "event_id", F.least(F.coalesce("top", F.lit(0)), F.lit(99)).alias("progress"))
