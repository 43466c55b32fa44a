"""Column layouts of the engine's tables, as DDL."""

#: Dense images: pixels are row-major.
FRAMES = "series_id string, i long, j string, name string, path string, height int, width int, dtype string, pixels array<double>, error string"
PAIRS = "key long, name0 string, name1 string, height int, width int, px0 array<double>, px1 array<double>, error string"
#: One row per displacement vector; null dx and dy mean that there is none.
VECTORS = (
    "key long, pass int, ivec int, ixvec int, iyvec int, x double, y double, dx double, dy double, correl_max double, "
    "dx_input int, dy_input int, dx_wrong double, dy_wrong double, errors string, error_code int, "
    "secondary_peaks array<struct<dx:double,dy:double,correl:double>>, dx_final double, dy_final double"
)
FIELDS = "field_id long, t double, iy int, ix int, x double, y double, vx double, vy double"
VOXELS = "ivox long, x double, y double, z double, intensity double"
FAILURES = "operator string, key string, message string"
CALIB_POINTS = "camera string, plane int, i int, X double, Y double, Z double, x double, y double"
