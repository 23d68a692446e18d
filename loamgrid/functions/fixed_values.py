"""Word lists, patterns and thresholds that define the results.

They are stated plainly and in natural order; no logic lives here.
"""

# Header aliases of the core fields.
FIELD_ALIASES = {
    "lon": ["lon", "longitude", "long", "lng", "x", "x_4326", "lon_wgs84", "longitude_wgs84", "sample_lon", "sample_longitude", "经度", "东经", "样点经度", "采样点经度"],
    "lat": ["lat", "latitude", "y", "y_4326", "lat_wgs84", "latitude_wgs84", "sample_lat", "sample_latitude", "纬度", "北纬", "样点纬度", "采样点纬度"],
    "som": [
        "som", "som_value", "som_gkg", "som_g_kg", "som含量", "om", "om_value", "om_gkg", "om_g_kg", "om含量",
        "soil_organic_matter", "organic_matter", "土壤有机质", "土壤有机质含量", "有机质", "有机质含量", "有机质gkg",
        "soc", "soil_organic_carbon", "organic_carbon", "有机碳", "土壤有机碳", "target_som", "target_om", "目标有机质",
    ],
    "sample_id": ["sample_id", "id", "fid", "objectid", "编号", "样点编号", "点号", "样本编号"],
    "year": ["year", "sample_year", "output_year", "年份", "采样年份", "制图年份", "调查年份", "sample_date", "date", "采样时间"],
    "depth": ["depth", "sample_depth", "采样深度", "土层深度", "深度", "depth_cm"],
}
REQUIRED_FIELDS = ["lon", "lat", "som"]

# Columns that are never covariates (normalised names).
AUX_EXACT = [
    "sampleid", "id", "fid", "objectid", "index", "序号", "编号", "样点编号", "点号",
    "year", "sampleyear", "outputyear", "targetyear", "年份", "采样年份", "制图年份", "调查年份",
    "depth", "sampledepth", "depthcm", "采样深度", "土层深度", "深度", "row", "col", "rows", "cols", "像元行", "像元列",
]
AUX_CONTAINS = [
    "samplelon", "samplelat", "longitude", "latitude", "lonwgs84", "latwgs84", "sampleyear", "outputyear", "targetyear",
    "date", "time", "日期", "时间", "crs", "epsg", "projection", "坐标系", "投影", "targetcrs",
    "scale", "resolution", "targetscale", "分辨率", "像元大小", "单位",
]
LEAK_CONTAINS = [
    "som", "soilorganicmatter", "organicmatter", "om", "soc", "soilorganiccarbon", "organiccarbon",
    "有机质", "土壤有机质", "有机碳", "土壤有机碳", "target", "目标",
    "prediction", "predicted", "predict", "pred", "map", "result", "预测", "结果", "有机质图",
]

# Predictors that would leak the target or are bookkeeping (training side).
LEAK_EXACT = [
    "sample_id", "id", "point_id", "编号", "样点编号", "点号", "lon", "lat", "longitude", "latitude", "经度", "纬度",
    "x", "y", "x_32648", "y_32648", "x_4326", "y_4326", "proj_x", "proj_y", "row", "col", "grid_row", "grid_col",
    "pixel_row", "pixel_col", "是否在目标区内", "协变量缺失数", "协变量缺失率", "spatial_block", "grid_block_id",
    "year", "年份", "depth", "深度",
]
LEAK_TOKENS = ["som_topsoil", "som_mask", "soil_organic_matter_map", "organic_matter_map", "有机质图", "有机质栅格", "soc_map"]

# Land-cover classes.
LANDCOVER = {1: "农田", 2: "森林", 3: "灌木", 4: "草地", 5: "水体", 6: "冰雪", 7: "裸地", 8: "不透水面", 9: "湿地"}

# Layers whose values are classes.
CATEGORY_WORDS = ["lulc", "clcd", "landcover", "land_cover", "worldcover", "cropland_mask", "admin_mask", "mask", "classification", "class"]

# Characters that show a wrongly decoded text.
MOJIBAKE = "�ÃÂÊËÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿº¹²³¼½¾¿"

# Layer-name words that decide whether an undated file changes over time.
DYNAMIC_WORDS = [
    "lulc", "clcd", "landcover", "land_cover", "worldcover", "crop", "cropland", "chinacp", "management", "seasonal", "climate", "water",
    "veg", "phenology", "ndvi", "evi", "npp", "fvc", "irrig", "irrigation", "planting", "pattern", "cropping", "利用", "作物", "复种", "灌溉",
]
RESOLUTION_COLUMNS = [
    "target_scale_m", "target_resolution_m", "resolution_m", "scale_m", "grid_m", "pixel_size_m", "cell_size_m", "spatial_resolution_m",
    "目标分辨率", "目标分辨率米", "分辨率", "像元大小", "像元尺寸",
]

# Default cell size in metres per area level, and the limit below which it applies.
LEVEL_RESOLUTION = {"county": 30.0, "city": 250.0, "province": 500.0, "country": 1000.0}
FINE_LIMIT_M = 31.0

# Tried text encodings and separators.
ENCODINGS = ["utf-8-sig", "utf-8", "gb18030", "gbk", "cp936", "gb2312", "big5", "cp950", "utf-16", "utf-16-le", "utf-16-be", "latin1"]
ENCODING_ALIAS = {"gb2312": "gb18030", "gb_18030": "gb18030", "windows-936": "gbk", "ms936": "gbk", "ascii": "utf-8"}
SIMPLE_ENCODINGS = ["utf-8-sig", "utf-8", "gb18030", "gbk", "cp936"]
SEPARATORS = [",", "\t", ";", "|"]

EXTREME_ABS = 1e30
YEAR_RANGE = (1980, 2035)

# Coordinate system aliases and their codes.
CRS_ALIASES = {
    "wgs84": "EPSG:4326", "epsg4326": "EPSG:4326", "经纬度": "EPSG:4326",
    "cgcs2000": "EPSG:4490", "国家2000": "EPSG:4490", "国家大地2000": "EPSG:4490", "2000国家大地坐标系": "EPSG:4490",
    "webmercator": "EPSG:3857", "web墨卡托": "EPSG:3857", "墨卡托": "EPSG:3857",
    "北京54": "EPSG:4214", "beijing54": "EPSG:4214", "西安80": "EPSG:4610", "xian80": "EPSG:4610",
    "cgcs2000albers": "albers_cgcs2000", "cgcs2000阿尔伯斯": "albers_cgcs2000", "cgcs2000albers等面积": "albers_cgcs2000",
    "中国阿尔伯斯": "albers_cgcs2000", "中国albers": "albers_cgcs2000", "阿尔伯斯等面积": "albers_cgcs2000", "albers": "albers_cgcs2000",
    "克拉索夫斯基阿尔伯斯": "albers_krasovsky", "krasovskyalbers": "albers_krasovsky",
}

# Names of data sets and the words that mean them.
DATA_ALIASES = {
    "DEM": ["dem", "数字高程", "高程模型", "高程", "海拔", "地形", "srtm", "aster gdem", "gdem"],
    "NDVI": ["ndvi", "植被指数"],
    "EVI": ["evi", "增强植被指数"],
    "LAI": ["lai", "叶面积指数"],
    "FVC": ["fvc", "植被覆盖度", "植被覆盖率"],
    "LULC": ["lulc", "土地利用", "土地覆盖", "lucc", "clcd", "地表覆盖"],
    "NPP": ["npp", "净初级生产力", "生产力"],
    "降水": ["降水", "降雨", "precipitation", "rainfall"],
    "气温": ["气温", "温度", "temperature", "地表温度", "lst"],
    "潜在蒸散发量": ["潜在蒸散发量", "潜在蒸散发", "潜在蒸散量", "参考蒸散发", "参考作物蒸散发", "potential evapotranspiration", "pet", "et0", "et₀", "eto"],
    "实际蒸散发量": ["实际蒸散发量", "实际蒸散发", "蒸散发量", "蒸散发", "actual evapotranspiration", "evapotranspiration", "aet", "et"],
    "风速": ["风速", "风场", "wind speed", "wind"],
    "相对湿度": ["相对湿度", "湿度", "relative humidity", "humidity", "rh"],
    "气象": ["气象", "水热"],
    "土壤水分": ["土壤水分", "土壤湿度", "soil moisture", "sm"],
    "土壤": ["土壤", "ph", "有机质", "质地", "砂粒", "黏粒", "容重"],
    "水文": ["水文", "径流", "河流", "湖泊", "水系", "冰川", "积雪"],
    "遥感影像": ["遥感影像", "landsat", "sentinel", "modis", "高分", "gf", "影像"],
    "地表太阳辐射": ["地表太阳辐射", "太阳辐射", "短波辐射", "地表下行短波辐射", "surface solar radiation", "solar radiation", "ssrd"],
}
PRIORITY_DATA = ["潜在蒸散发量", "实际蒸散发量", "地表太阳辐射", "土壤水分", "相对湿度", "风速", "气温", "降水", "NDVI", "EVI", "LAI", "FVC", "LULC", "DEM"]

# Class words of a request, in order of preference; a word listed twice means the first code.
SCOPE_ALIASES = [
    (1, ["耕地", "农田", "农用地", "耕作地", "种植地"]), (2, ["林地", "森林", "树林", "乔木林", "有林地"]), (3, ["灌木", "灌丛", "灌木林"]),
    (4, ["草地", "草原", "牧草地"]), (5, ["水体", "水域", "湖泊", "河流", "湿地"]), (6, ["冰雪", "冰川", "积雪"]),
    (7, ["裸地", "裸土", "荒地", "未利用地"]), (8, ["建设用地", "不透水面", "城镇", "城市建设区", "居民地"]), (9, ["湿地", "沼泽", "湿地区"]),
]
FULL_DOMAIN = "全域|全市|全成都|全成都市|整个成都市|全范围|全部区域|所有区域|不掩膜|不要掩膜|取消掩膜|不按地类"

# Corrections of frequent typing mistakes, applied in order.
TYPOS = {
    "土朗有机质": "土壤有机质", "土嚷有机质": "土壤有机质", "土壤有机值": "土壤有机质", "有机值": "有机质", "有机资": "有机质",
    "不确丁性": "不确定性", "不确定形": "不确定性", "不确定醒": "不确定性", "成度": "成都", "成都是": "成都市",
    "靠不靠谱": "是否可靠", "稳不稳": "是否可靠", "准不准": "精度怎么样", "出一张图": "绘制一张图", "环静变量": "环境变量",
    "环境因孑": "环境因子", "环竟变量": "环境变量", "协表量": "协变量", "制囹": "制图", "土壤右机质": "土壤有机质", "制图任努": "制图任务", "靠普": "靠谱",
}
SOIL_TERMS = [
    "数字土壤制图", "土壤有机质", "有机质", "环境变量", "环境因子", "协变量", "遥感", "地形", "气候", "土地利用", "母质", "土壤质地",
    "空间验证", "不确定性", "成都市", "成都", "som", "rfk", "gcp", "制图", "出图", "预测图", "分布图", "精度", "结果", "图件",
]
CAR_TERMS = [
    "mitsubishi", "eclipse", "talon", "plymouth", "laser", "4g63", "brembo", "engine", "brake", "caliper",
    "dsmtuners", "galant", "vr-4", "fuse", "wiring", "plug",
]

# Administrative suffixes, longest forms first.
ADMIN_SUFFIXES = ["特别行政区", "壮族自治区", "维吾尔自治区", "回族自治区", "自治区", "地区", "自治州", "盟", "省", "市", "县", "区", "旗"]
REGION_SUFFIXES = ["省", "市", "区", "县", "州", "盟", "旗"]

# File extensions and words of data downloads.
DOWNLOAD_EXTS = [".zip", ".rar", ".7z", ".xls", ".xlsx", ".csv", ".tif", ".tiff", ".nc", ".hdf", ".h5", ".hdf5", ".json", ".geojson"]
DOWNLOAD_WORDS = ["download", "downfile", "export", "fileid", "file_id", "attach", "attachment", "getfile", "datafile", "下载"]
INTERFACE_WORDS = ["download", "downfile", "getfile", "export", "fileid", "file_id", "attachment"]
PAGE_WORDS = ["source", "product", "dataset", "data", "search", "query", "download", "api", "detail", "catalog", "资源", "产品", "数据", "下载", "检索", "详情"]
REAL_FILE_EXTS = [".tif", ".tiff", ".img", ".vrt", ".zip", ".rar", ".7z", ".hdf", ".h5", ".hdf5", ".nc", ".csv", ".xls", ".xlsx", ".geojson", ".json"]
WEB_FILE_EXTS = [".html", ".htm", ".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".txt"]
MIN_REAL_FILE_BYTES = 10240
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]

# Covariates and the words in file names that mean them.
COVARIATE_ALIASES = {
    "DEM": ["dem", "elevation", "高程", "海拔"], "BD": ["bd", "bulk_density", "容重", "土壤容重"], "CEC": ["cec", "阳离子交换", "cation"],
    "pH": ["ph", "soilph"], "sand": ["sand", "砂", "砂粒"], "silt": ["silt", "粉砂", "粉粒"], "clay": ["clay", "黏土", "粘土", "黏粒"],
    "gravel": ["gravel", "砾石", "砾"], "porosity": ["porosity", "孔隙", "孔隙度"], "CLCD": ["clcd"],
    "LULCcd": ["lulc", "landcover", "land_cover", "土地覆盖", "土地利用"], "BareSoil": ["baresoil", "bare_soil", "裸土"],
    "ChinaCP": ["chinacp", "复种", "cropping", "crop_intensity"], "Management": ["management", "管理", "human", "人为"],
    "VegPhenology": ["vegphenology", "phenology", "modis", "ndvi", "evi", "vegetation", "植被", "物候"],
    "SeasonalClimateWater": ["seasonalclimatewater", "climate", "precip", "temperature", "temp", "water", "气候", "降水", "温度", "水热"],
}

# Log messages (lower case) and the stage percentage each one reaches, first match wins.
PROGRESS_MARKS = [
    ("已进入 pro 自动数据准备流程", 5), ("样点csv读取成功", 10), ("已从本地行政区划", 13), ("已使用本地行政区划", 13), ("正式制图流程启动", 16),
    ("环境协变量选择方案已确定", 19), ("规则自动确定目标分辨率", 21), ("建模样点表.csv已生成", 48), ("最终建模csv已生成", 48),
    ("即将启动rfk训练", 50), ("从建模样点表重新开始训练", 50), ("已识别融合csv训练诊断特征", 52), ("开始构建rfk训练矩阵", 52), ("clean rfk 开始联合寻参", 55),
]
PROGRESS_LATE = [
    ("完成联合寻参", 72), ("空间7:3验证完成", 75), ("空间7:3验证", 73), ("随机7:3验证完成", 77), ("随机7:3验证", 76), ("重复验证完成", 79),
    ("已训练正式出图rfk模型", 81), ("预测网格", 84), ("开始生成正式geotiff", 88), ("clean rfk 建模完成", 94), ("正式制图流程结束", 98), ("任务成功完成", 99),
]

# Headers of the band number and of the feature name in a band table.
BAND_HEADERS = ["band", "band_index", "index", "波段", "波段号", "band_id"]
BAND_NAME_HEADERS = ["feature_name", "name", "feature", "variable", "covariate", "字段名", "变量名", "协变量", "band_name"]
