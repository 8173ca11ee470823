"""Specs as data: role dictionaries, metric lists, thresholds, dimension tables.

Operators never hard-code a metric or a role; they read these tables. The
football spec below and the driver-table spec in ``sources/fixtures.py`` go
through the same code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES - these must equal the reference's values for equal results.
# ---------------------------------------------------------------------------
MIN_MINUTES = 600          # eligibility floor
FULL_SEASON = 1800         # minutes of full evidence
MIN_CELL = 10              # smallest league x role cell that is percentiled alone
MIN_ATTEMPTS = 20          # attempts below which a percentage is shrunk
LEAGUE_WEIGHT = 0.35       # share of the final score that is league strength
MIN_MEDIAN_SUPPORT = 20    # priced players needed for a league median
MAX_LISTED = 500           # differences listed in full by compare
PREVIEW_N = 5              # preview rows per side in compare
# key columns tried in this order when compare gets no key
DEFAULT_KEYS = [["Player", "Team within selected timeframe", "Age"], ["Player", "Team", "Age"], ["Player", "Age"], ["Player"]]
CANDIDATE_MAX_AGE = 25     # candidate pool of the report
TOP_FRACTION = 0.90        # top-decile cut of the report's validation
RETENTION_FRACTION = 0.15  # top share used by retention
STRENGTH_BAND_EDGES = [-0.1, 15, 30, 50, 101]
STRENGTH_BAND_LABELS = ["d", "c", "b", "a"]
AGE_BAND_EDGES = [0, 19, 21, 25, 200]
AGE_BAND_LABELS = ["16-19", "20-21", "22-25", "26+"]
PRIORITY_RANK = {"green": 1, "yellow": 2, "red": 3}
DIVISION_FACTOR = {1: 1.00, 2: 0.55, 3: 0.32, 4: 0.18}
ILLEGAL_PATH_CHARS = '<>:"/\\|?*'

# Position code -> role, and role labels.
ROLE_OF_POSITION = {
    "GK": "GK",
    "CB": "CB", "RCB": "CB", "LCB": "CB",
    "RB": "FB", "LB": "FB", "RWB": "FB", "LWB": "FB",
    "DMF": "DM", "RDMF": "DM", "LDMF": "DM",
    "CMF": "CM", "RCMF": "CM", "LCMF": "CM",
    "AMF": "AM",
    "LW": "W", "RW": "W", "LWF": "W", "RWF": "W", "LAMF": "W", "RAMF": "W",
    "CF": "CF",
}
ROLE_LABEL = {"GK": "Goalkeeper", "CB": "Centre back", "FB": "Full back",
              "DM": "Defensive midfielder", "CM": "Central midfielder",
              "AM": "Attacking midfielder", "W": "Winger", "CF": "Centre forward"}

# Role -> metrics, in the order they are averaged.
ROLE_METRICS = {
    "GK": ["Save rate, %", "Prevented goals per 90", "Conceded goals per 90",
           "Exits per 90", "Accurate passes, %", "Accurate long passes, %"],
    "CB": ["Defensive duels won, %", "Aerial duels won, %", "PAdj Interceptions",
           "Shots blocked per 90", "Successful defensive actions per 90",
           "Accurate passes, %", "Accurate progressive passes, %"],
    "FB": ["Defensive duels won, %", "PAdj Interceptions", "Successful defensive actions per 90",
           "Crosses per 90", "Accurate crosses, %", "Progressive runs per 90",
           "xA per 90", "Key passes per 90"],
    "DM": ["PAdj Interceptions", "Defensive duels won, %", "Successful defensive actions per 90",
           "Accurate passes, %", "Accurate forward passes, %", "Progressive passes per 90",
           "Received passes per 90"],
    "CM": ["Progressive passes per 90", "Accurate passes, %", "Key passes per 90",
           "xA per 90", "Progressive runs per 90", "Passes to final third per 90",
           "Duels won, %"],
    "AM": ["xA per 90", "Key passes per 90", "Through passes per 90", "Shot assists per 90",
           "Passes to penalty area per 90", "Dribbles per 90", "Successful dribbles, %",
           "Touches in box per 90", "xG per 90"],
    "W": ["Successful dribbles, %", "Progressive runs per 90", "Accelerations per 90",
          "xA per 90", "Key passes per 90", "Crosses per 90", "Accurate crosses, %",
          "xG per 90", "Touches in box per 90", "Fouls suffered per 90"],
    "CF": ["Non-penalty goals per 90", "xG per 90", "Goal conversion, %", "Shots on target, %",
           "Touches in box per 90", "Head goals per 90", "Aerial duels won, %",
           "Fouls suffered per 90"],
}
LOWER_IS_BETTER = {"Conceded goals per 90", "xG against per 90", "Fouls per 90"}
PERCENTAGE_VOLUME = {
    "Successful dribbles, %": "Dribbles per 90",
    "Shots on target, %": "Shots per 90",
    "Goal conversion, %": "Shots per 90",
    "Accurate crosses, %": "Crosses per 90",
    "Accurate passes, %": "Passes per 90",
    "Accurate long passes, %": "Long passes per 90",
    "Accurate forward passes, %": "Forward passes per 90",
    "Accurate progressive passes, %": "Progressive passes per 90",
    "Accurate through passes, %": "Through passes per 90",
    "Defensive duels won, %": "Defensive duels per 90",
    "Aerial duels won, %": "Aerial duels per 90",
    "Duels won, %": "Duels per 90",
    "Save rate, %": "Shots against per 90",
}

# Concept list of the flat index (metrics averaged inside a concept, then
# concepts averaged); the age concept is the inverted age percentile.
CONCEPTS = {
    "Goal output": ["Goals per 90", "xG per 90"],
    "Shot threat": ["Shots per 90"],
    "Chance creation": ["Assists per 90", "xA per 90"],
    "Through balls": ["Through passes per 90"],
    "Dribbling": ["Dribbles per 90", "Successful dribbles, %", "Progressive runs per 90"],
    "Key passing": ["Key passes per 90"],
    "Passing": ["Passes per 90", "Accurate passes, %"],
    "Fouls drawn": ["Fouls suffered per 90"],
    "Minutes": ["Minutes played"],
    "Age (younger)": None,
}
BLOCKS = {
    "Goal threat": ["Goal output", "Shot threat"],
    "Creative": ["Chance creation", "Through balls", "Key passing"],
    "Dribbling": ["Dribbling"], "Passing": ["Passing"],
    "Fouls drawn": ["Fouls drawn"], "Minutes": ["Minutes"],
    "Age (younger)": ["Age (younger)"],
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ScoreParams:
    min_minutes: float = MIN_MINUTES
    full_season: float = FULL_SEASON
    min_cell: int = MIN_CELL
    min_attempts: float = MIN_ATTEMPTS
    league_weight: float = LEAGUE_WEIGHT
    pool: str = "thin"          # "thin": only thin rows pool by band; "all": every row of the band
    band_edges: tuple = tuple(STRENGTH_BAND_EDGES)
    band_labels: tuple = tuple(STRENGTH_BAND_LABELS)


@dataclass
class MetricSpec:
    """role -> ordered metrics; lower-is-better set; percentage -> volume metric; display labels."""
    role_metrics: dict
    lower_is_better: set = field(default_factory=set)
    volume_of: dict = field(default_factory=dict)
    labels: dict = field(default_factory=dict)
    role_labels: dict = field(default_factory=dict)

    def groups_df(self, spark: SparkSession) -> DataFrame:
        """Per role its label and metrics as (col, label, higher), in scoring order."""
        schema = T.StructType([
            T.StructField("role", T.StringType(), False),
            T.StructField("label", T.StringType(), True),
            T.StructField("metrics", T.ArrayType(T.StructType([
                T.StructField("col", T.StringType()), T.StructField("label", T.StringType()),
                T.StructField("higher", T.BooleanType())]))),
        ])
        rows = [(role, self.role_labels.get(role, role),
                 [(m, self.labels.get(m, m), m not in self.lower_is_better) for m in metrics])
                for role, metrics in self.role_metrics.items()]
        return spark.createDataFrame(rows, schema)

    def rows(self):
        out = []
        for role, metrics in self.role_metrics.items():
            for i, m in enumerate(metrics):
                out.append((role, i, m, m in self.lower_is_better, self.volume_of.get(m)))
        return out

    def metrics(self) -> list[str]:
        seen = []
        for ms in self.role_metrics.values():
            for m in ms:
                if m not in seen:
                    seen.append(m)
        for v in self.volume_of.values():
            if v not in seen:
                seen.append(v)
        return seen

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([
            T.StructField("role", T.StringType(), False),
            T.StructField("ordinal", T.IntegerType(), False),
            T.StructField("metric", T.StringType(), False),
            T.StructField("lower_is_better", T.BooleanType(), False),
            T.StructField("volume_metric", T.StringType(), True),
        ])
        return spark.createDataFrame(self.rows(), schema)


FOOTBALL_SPEC = MetricSpec(ROLE_METRICS, set(LOWER_IS_BETTER), dict(PERCENTAGE_VOLUME),
                           role_labels=dict(ROLE_LABEL))


def kv_df(spark: SparkSession, mapping: dict, key: str, value: str,
          key_type=T.StringType(), value_type=T.StringType()) -> DataFrame:
    """A small constant dictionary as a two-column DataFrame (J2 lookups)."""
    schema = T.StructType([T.StructField(key, key_type, False), T.StructField(value, value_type, True)])
    return spark.createDataFrame(list(mapping.items()), schema)
