"""They define the results, so they are stated here as plain text and nowhere else."""

# Labels. POSITIVE_LABEL maps to 1, the other known labels to 0, everything else is unlabelled.
POSITIVE_LABEL = "Lead"
KNOWN_LABELS = ("Lead", "Copper", "Galvanized")
LABEL_DOMAIN = ("Lead", "Copper", "Galvanized", "Unknown")
LABEL_SPELLINGS = {
    "lead": "Lead",
    "copper": "Copper",
    "galvanized": "Galvanized",
    "galvanized steel": "Galvanized",
    "unknown": "Unknown",
    "not determined": "Unknown",
}
LABEL_SOURCES = ("inspected", "self_reported", "unknown")
INSPECTION_SOURCES = ("field_inspection", "self_report_verified")
SET_LABELS = ("NotLead", "Lead")

# Raw header names and the column names they become.
INVENTORY_COLUMNS = {
    "Street Address": "address",
    "ZIP Code": "zip_code",
    "Ward": "ward",
    "Property Type": "property_type",
    "Service Line Material": "service_line_material",
    "Latitude": "latitude",
    "Longitude": "longitude",
}
ASSESSOR_COLUMNS = {
    "PIN": "pin",
    "Address": "address",
    "Year Built": "year_built",
    "Class": "property_class",
    "Land Area (Sq Ft)": "lot_size_sqft",
    "Building Sq Ft": "building_sqft",
    "Stories": "stories",
}
INCOME_COLUMN = "B19013_001E"
TRACT_PREFIX = "17031"
TRACT_WIDTH = 6
ID_PREFIX = "chi-"
INSPECTION_ID_PREFIX = "insp-"
ID_HEX_DIGITS = 12

# Geography.
EARTH_RADIUS_M = 6_371_000.0
NO_HYDRANT_DISTANCE_M = 5000.0
NO_POSITIVE_DISTANCE_M = 10000.0
COARSE_HEX_EDGE_M = 531.414
FINE_HEX_EDGE_M = 200.786
NEIGHBOURS = 10

# History.
NO_HISTORY_DAYS = 3650

# Columns that must never reach a feature table.
FORBIDDEN_COLUMNS = (
    "income_quartile",
    "median_household_income",
    "race",
    "ethnicity",
    "pct_nonwhite",
    "pct_minority",
)

# Feature groups, in model order.
INTRINSIC = ("year_built", "lot_size_sqft", "building_sqft", "stories", "has_basement")
GEO = ("dist_to_nearest_hydrant_m",)
PROCESS = (
    "inspection_count_in_ward",
    "known_lead_count_in_ward",
    "days_since_last_inspection_in_ward",
)
OBSERVED = (
    "dist_to_nearest_known_lead_m",
    "neighbor_lead_rate_h3res8",
    "knn10_lead_rate",
    "known_lead_rate_in_ward",
)
FEATURE_SETS = {
    "intrinsic": INTRINSIC,
    "intrinsic_geo": INTRINSIC + GEO,
    "intrinsic_geo_process": INTRINSIC + GEO + PROCESS,
    "full": INTRINSIC + GEO + PROCESS + OBSERVED,
}
BASELINE_FEATURES = INTRINSIC + GEO + ("dist_to_nearest_known_lead_m",)
LINEAR_FEATURES = BASELINE_FEATURES + (
    "neighbor_lead_rate_h3res8",
    "knn10_lead_rate",
    "known_lead_rate_in_ward",
)
PROPENSITY_FEATURES = INTRINSIC + GEO

# Decisions.
STRATEGIES = (
    "random",
    "risk",
    "uncertainty",
    "risk_uncertainty",
    "risk_uncertainty_equity",
    "oracle",
)
HEURISTIC_YEAR = 1950
DECISION_THRESHOLD = 0.5
DISPARITY_LIMIT = 0.05
MISSING_QUARTILE = 2
MIN_GROUP_ROWS = 5
SEED = 42
