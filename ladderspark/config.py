"""Rating parameters and the one-row configuration table."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RatingConfig:
    # The published default rating configuration.
    mu0: float = 25.0
    sigma0: float = 8.333
    live_window_days: int = 730
    min_runs: int = 5
    min_field: int = 6
    min_ranked: int = 2
    major_event_weight: float = 1.2
    sigma_decay: float = 0.99
    sigma_min: float = 1.5
    display_base: float = 1000.0
    display_scale: float = 40.0
    sigma_multiplier: float = 1.0
    podium_base: float = 0.85
    podium_range: float = 0.20
    podium_target: float = 0.50
    provisional_sigma: float = 7.8
    norm_mean: float = 1500.0
    norm_std: float = 150.0
    elite_top: float = 0.02
    champion_top: float = 0.10
    expert_top: float = 0.30
    country_top_n: int = 10
    min_country_teams: int = 3
    # Model constants of the published Plackett-Luce rating scheme.
    kappa: float = 1e-4
    tau: float = 0.0

    @property
    def beta(self) -> float:
        return self.mu0 / 6.0

    def as_frame(self, spark: SparkSession, config_id: int = 1, active: bool = True) -> DataFrame:
        row = {"config_id": config_id, "is_active": active, **asdict(self)}
        return spark.createDataFrame([row])

    @classmethod
    def from_row(cls, row) -> "RatingConfig":
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in row.asDict().items() if k in known})


def activate(configs: DataFrame, new: DataFrame) -> DataFrame:
    """Append a configuration and make it the only active one."""
    old = configs.withColumn("is_active", F.lit(False))
    return old.unionByName(new.withColumn("is_active", F.lit(True)))


def active_config(configs: DataFrame) -> DataFrame:
    """The active row with the highest id (a configuration table has a handful of rows)."""
    newest = Window.orderBy(F.col("config_id").desc())
    return (
        configs.filter("is_active")
        .withColumn("_rn", F.row_number().over(newest))
        .filter("_rn = 1")
        .drop("_rn")
    )


def seed_config(spark: SparkSession, configs: DataFrame | None) -> DataFrame:
    """Default configuration if no active one exists, otherwise the table unchanged."""
    default = RatingConfig().as_frame(spark)
    if configs is None:
        return default
    missing = default.join(configs.filter("is_active").select(F.lit(1).alias("_x")).limit(1),
                           F.lit(1) == F.col("_x"), "left_anti")
    return configs.unionByName(missing)
