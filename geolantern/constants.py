"""Fixed values that results depend on."""

# WGS84 ellipsoid and mean Earth radius, in metres.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
WGS84_B = WGS84_A * (1.0 - WGS84_F)
EARTH_RADIUS_M = 6371008.7714

# Metres and kilometres per degree used for radii and profiling.
METRES_PER_DEGREE = 111_320.0
KM_PER_DEGREE = 111.32

# Upper bound of metres per degree on the ellipsoid (meridian arc at the pole).
MAX_METRES_PER_DEGREE = 111_700.0
# The spheroidal and the spherical distance differ by less than this fraction.
SPHERE_SLACK = 0.006

# Prepositions in lookup order.
PREPOSITIONS = (
    "in", "at", "on", "near", "by", "around", "to", "from", "with", "about",
    "inside", "outside", "between", "among", "across", "through", "over", "under",
)

# Tag keys a generated query may use, in order of preference.
PRIORITY_KEYS = (
    "amenity", "shop", "name", "cuisine", "building", "tourism", "leisure",
    "highway", "public_transport", "office",
)

# Text of a point or query without any tag text.
EMPTY_TEXT = "poi"

# Frequency bands of the sinusoidal coordinate features.
BANDS = (1.0, 2.0, 4.0, 8.0)

# Rounding of query coordinates and query vectors.
COORD_DECIMALS = 8
VECTOR_DECIMALS = 6

# Workload families, the scenarios and the methods they compare.
FAMILIES = ("", "embedded_", "concat_embedded_", "contrastive_embedded_")
SCENARIOS = {
    "concat": ("concat_embedding",),
    "contrast": ("contrastive_embedding",),
    "fused": ("concat_embedding", "contrastive_embedding"),
    "all": (
        "no_index", "spatial_index", "keyword_index", "spatial_keyword_index",
        "pgvector_embedding", "spatial_and_pgvector_embedding",
        "concat_embedding", "contrastive_embedding",
    ),
    "existing": (
        "no_index", "spatial_keyword_index", "pgvector_embedding",
        "spatial_and_pgvector_embedding",
    ),
    "non_embedded": ("no_index", "spatial_index", "keyword_index", "spatial_keyword_index"),
    "embedded": (
        "spatial_and_pgvector_embedding", "concat_embedding", "contrastive_embedding",
    ),
}

# The workload family that each method answers.
METHOD_FAMILY = {
    "no_index": "", "spatial_index": "", "keyword_index": "", "spatial_keyword_index": "",
    "pgvector_embedding": "embedded_", "spatial_and_pgvector_embedding": "embedded_",
    "concat_embedding": "concat_embedded_", "contrastive_embedding": "contrastive_embedded_",
}

# White space stripped from texts on both ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Similarities are ranked after rounding, so summation order cannot split ties.
SIMILARITY_DECIMALS = 9
# Distances are ranked in micrometres for the same reason.
DISTANCE_DECIMALS = 6
