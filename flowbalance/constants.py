"""Fixed values of the domain.

Everything in this module is a given: lookup tables, constants and value ranges that results
depend on. Nothing here is computed and nothing here grows with the data.
"""

from __future__ import annotations

# The masses of a flow, in lb. fat + snf + water = volume.
COMPONENTS = ("fat", "snf", "water")
MASSES = ("volume", *COMPONENTS)

# Cheese recipes
# (cheese_type, moisture, fat_recovery, casein_fat_ratio, casein_recovery).
RECIPES = (
    ("cheddar", 0.37, 0.90, 0.68, 0.75),
    ("mozzarella", 0.47, 0.85, 0.95, 0.75),
    ("swiss", 0.38, 0.88, 0.80, 0.75),
    ("parmesan", 0.30, 0.88, 1.20, 0.75),
)
CHEESE_TYPES = ("cheddar", "mozzarella", "swiss", "parmesan")
POWDER_TYPES = ("nfdm", "bmp", "wmp")

# Market parameters (product, base_price $/lb, demand lb, elasticity).
MARKET = (
    ("butter", 2.50, 100.0, 0.3),
    ("nfdm", 1.20, 80.0, 0.3),
    ("bmp", 1.40, 30.0, 0.3),
    ("wmp", 1.80, 50.0, 0.3),
    ("cheddar", 1.80, 120.0, 0.3),
    ("mozzarella", 1.90, 100.0, 0.3),
    ("swiss", 2.20, 40.0, 0.3),
    ("parmesan", 3.50, 30.0, 0.3),
    ("whey", 0.40, 200.0, 0.2),
)
PRODUCTS = ("butter", "nfdm", "bmp", "wmp", "cheddar", "mozzarella", "swiss", "parmesan", "whey")

# Process constants.
LEAN_FAT_FRACTION = 0.001
CASEIN_SHARE_OF_SNF = 0.296
EXCESS_FAT_THRESHOLD = 0.001
BUTTER_SNF_FRACTION = 0.015
WHOLE_MILK_POWDER_FAT_FRACTION = 0.26
CHURN_FAT_RECOVERY = 0.99

# Tolerances (closure in lb, audit in percent of the input, price dead band in $/lb).
CLOSURE_TOLERANCE = 0.001
AUDIT_TOLERANCE_PCT = 0.1
PRICE_DEAD_BAND = 0.001

# The default plant configuration.
DEFAULT_CONFIG = {
    "volume": 1000.0,
    "fat_pct": 4.0,
    "snf_pct": 9.0,
    "cream_fat_pct": 40.0,
    "skim_split_pct": 50.0,
    "cream_split_pct": 50.0,
    "butter_a_fat_pct": 82.0,
    "powder_a": "nfdm",
    "butter_b_fat_pct": 80.0,
    "powder_b": "bmp",
    "cheese_a": "cheddar",
    "cheese_b": "mozzarella",
}

# The override groups of a configuration. A scenario replaces a group as a whole.
CONFIG_GROUPS = {
    "producer": ("volume", "fat_pct", "snf_pct"),
    "separator": ("cream_fat_pct",),
    "skim_split": ("skim_split_pct",),
    "cream_split": ("cream_split_pct",),
    "butter_plant_a": ("butter_a_fat_pct", "powder_a"),
    "butter_plant_b": ("butter_b_fat_pct", "powder_b"),
    "cheese_plant_a": ("cheese_a",),
    "cheese_plant_b": ("cheese_b",),
}

# Parameter paths of the change log, with the column each one sets.
PARAM_PATHS = {
    "producer.fatPercent": "fat_pct",
    "producer.snfPercent": "snf_pct",
    "producer.productionRate": "volume",
    "separator.targetCreamFatPercent": "cream_fat_pct",
    "skimSplitPercent": "skim_split_pct",
    "creamSplitPercent": "cream_split_pct",
    "butterPlantA.targetButterFatPercent": "butter_a_fat_pct",
    "butterPlantB.targetButterFatPercent": "butter_b_fat_pct",
}

# Allowed range of each numeric parameter.
RANGES = {
    "fat_pct": (3.0, 5.0),
    "snf_pct": (7.5, 9.5),
    "volume": (100.0, 5000.0),
    "cream_fat_pct": (30.0, 45.0),
    "skim_split_pct": (0.0, 100.0),
    "cream_split_pct": (0.0, 100.0),
    "butter_a_fat_pct": (78.0, 84.0),
    "butter_b_fat_pct": (78.0, 84.0),
}

# Allowed members of each enumerated parameter.
MEMBERS = {
    "cheese_a": CHEESE_TYPES,
    "cheese_b": CHEESE_TYPES,
    "powder_a": POWDER_TYPES,
    "powder_b": POWDER_TYPES,
}

# The stress scenarios, as overrides of the default configuration.
STRESS_SCENARIOS = (
    ("baseline", {}),
    ("lean small herd", {"producer": {"fat_pct": 3.0, "snf_pct": 7.5, "volume": 100.0}}),
    ("rich large herd", {"producer": {"fat_pct": 5.0, "snf_pct": 9.5, "volume": 5000.0}}),
    ("cream at 30", {"separator": {"cream_fat_pct": 30.0}}),
    ("cream at 45", {"separator": {"cream_fat_pct": 45.0}}),
    ("skim all to b", {"skim_split": {"skim_split_pct": 0.0}}),
    ("skim all to a", {"skim_split": {"skim_split_pct": 100.0}}),
    ("cream all to b", {"cream_split": {"cream_split_pct": 0.0}}),
    ("cream all to a", {"cream_split": {"cream_split_pct": 100.0}}),
    (
        "parmesan only",
        {"cheese_plant_a": {"cheese_a": "parmesan"}, "cheese_plant_b": {"cheese_b": "parmesan"}},
    ),
    ("whole milk powder", {"butter_plant_a": {"butter_a_fat_pct": 78.0, "powder_a": "wmp"}}),
)
