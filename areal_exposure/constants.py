"""Codes, names and unit factors that the published results depend on."""

# Chemical codes of the two fumigants and the short labels used in column names.
CHEMICALS = {"573": "13d", "136": "chloropicrin"}

# Study period, the same span for calendar years and water years.
STUDY_YEARS = (2018, 2022)

# Columns of the use records that make up the land-survey section key, in key order.
SECTION_KEY_PARTS = ("county_cd", "base_ln_mer", "township", "tship_dir", "range", "range_dir", "section")

# Land-use classes on which the fumigants may be applied; idle land only in one subclass.
CROP_CLASSES = ("G", "R", "F", "P", "T", "D", "C", "V", "YP")
IDLE_CLASS = "I"
IDLE_SUBCLASS = "2"
CROP_SLOTS = (1, 2, 3, 4)

# The number that marks a missing score in the social-vulnerability table.
MISSING_SCORE = -999

# Unit factors.
SQ_METRES_PER_ACRE = 4046.8564224
ACRES_PER_SQ_METRE_LAND = 0.000247105  # as printed for the Census land-area column
METRES_PER_MILE = 1609.344

# Buffer distances around school grounds, in miles.
BUFFER_MILES = (0.25, 1.0)

# Column names of the social-vulnerability table and their readable names.
SVI_COLUMNS = {
    "county": "county",
    "fips": "fips",
    "area_sqmi": "area_sqmi",
    "e_hu": "housing_units",
    "e_hh": "households",
    "rpl_themes": "svi",
    "rpl_theme1": "socioeconomic_svi",
    "rpl_theme2": "household_svi",
    "rpl_theme3": "racial_svi",
    "rpl_theme4": "housing_transport_svi",
}

# Census estimate codes by readable name.
CENSUS_VARIABLES = {
    "population": "B01001_001",
    "poverty": "B17001_002",
    "population_assessed_poverty": "B17001_001",
    "born_central_america": "B05006_154",
    "population_5_and_older": "B16005_001",
    "median_household_income": "B19013_001",
    "limited_english_1": "B16005_007",
    "limited_english_2": "B16005_008",
    "limited_english_3": "B16005_012",
    "limited_english_4": "B16005_013",
    "limited_english_5": "B16005_017",
    "limited_english_6": "B16005_018",
    "limited_english_7": "B16005_022",
    "limited_english_8": "B16005_023",
    "limited_english_9": "B16005_029",
    "limited_english_10": "B16005_030",
    "limited_english_11": "B16005_034",
    "limited_english_12": "B16005_035",
    "limited_english_13": "B16005_039",
    "limited_english_14": "B16005_040",
    "limited_english_15": "B16005_044",
    "limited_english_16": "B16005_045",
    "male_under_5_yrs": "B01001_003",
    "male_5_9_yrs": "B01001_004",
    "male_10_14_yrs": "B01001_005",
    "male_15_17_yrs": "B01001_006",
    "female_under_5_yrs": "B01001_027",
    "female_5_9_yrs": "B01001_028",
    "female_10_14_yrs": "B01001_029",
    "female_15_17_yrs": "B01001_030",
    "latino": "B03003_003",
}

# Census shares in percent, as name -> (numerator, denominator).
CENSUS_SHARES = {
    "pc_poverty": ("poverty", "population_assessed_poverty"),
    "pc_age_17_and_below": ("age_17_and_below", "population"),
    "pc_latino": ("latino", "population"),
    "pc_limited_english": ("limited_english", "population_5_and_older"),
    "pc_born_central_america": ("born_central_america", "population"),
}

# Ellipsoid (GRS 80) and the equal-area conic grid of California (EPSG:3310).
GRS80_SEMI_MAJOR = 6378137.0
GRS80_INVERSE_FLATTENING = 298.257222101
ALBERS_STANDARD_PARALLELS = (34.0, 40.5)
ALBERS_ORIGIN = (-120.0, 0.0)
ALBERS_FALSE_EASTING_NORTHING = (0.0, -4000000.0)
