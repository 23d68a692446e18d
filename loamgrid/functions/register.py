"""Names for SQL: four SQL functions and one table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from loamgrid.functions import fixed_values as V

SUFFIXES = "|".join(V.ADMIN_SUFFIXES)

SQL_FUNCTIONS = {
    "dist2d": "(x1 double, y1 double, x2 double, y2 double) returns double return sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))",
    "extract_numeric": (
        r"(t string) returns double return try_cast(nullif(regexp_extract(regexp_replace(t, '[%％]', ''), "
        r"'([-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?)', 1), '') as double)"
    ),
    "strip_admin_suffix": f"(t string) returns string return regexp_replace(trim(t), '(?<=.)({SUFFIXES})$', '')",
    "weighted_quantile": (
        "(vals array<double>, weights array<double>, q double) returns double return aggregate("
        "array_sort(filter(arrays_zip(vals, weights), p -> p.vals is not null and p.weights > 0)), "
        "struct(cast(0 as double) as cum, q * aggregate(filter(arrays_zip(vals, weights), p -> p.vals is not null and p.weights > 0), "
        "cast(0 as double), (a, p) -> a + p.weights) as cut, cast(null as double) as ans), "
        "(a, p) -> struct(a.cum + p.weights as cum, a.cut as cut, coalesce(a.ans, if(a.cum + p.weights >= a.cut, p.vals, null)) as ans), a -> a.ans)"
    ),
}


@udtf(returnType="row int, col int, x double, y double")
class GridCells:
    """Cells of a box snapped outward to the cell size, rows from the top."""

    def eval(self, xmin: float, ymin: float, xmax: float, ymax: float, res: float):
        import math

        x0, y0 = math.floor(xmin / res) * res, math.ceil(ymax / res) * res
        w = max(1, math.ceil(xmax / res) - math.floor(xmin / res))
        h = max(1, math.ceil(ymax / res) - math.floor(ymin / res))
        for r in range(h):
            for c in range(w):
                yield r, c, x0 + (c + 0.5) * res, y0 - (r + 0.5) * res


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}{body}")
    spark.udtf.register("grid_cells", GridCells)
    return [*SQL_FUNCTIONS, "grid_cells"]
