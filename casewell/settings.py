"""Run settings, disease presets and a session with the defaults we rely on."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

# Spark's limit for the bytes of a generated method, and the size up to which the JVM compiles one.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
DEFAULT_METHOD_LIMIT, COMPILED_METHOD_LIMIT = "65535", "8000"

# Disease presets.
PRESETS = {
    "cholera": {"age_breaks": (0, 5, 15, 30, 50, 65, 80), "geocode_threshold": 78.0},
    "measles": {"age_breaks": (0, 1, 5, 10, 15, 30, 50), "geocode_threshold": 80.0},
    "ebola": {"age_breaks": (0, 5, 15, 30, 50, 65, 80), "geocode_threshold": 85.0},
    "covid19": {"age_breaks": (0, 10, 20, 30, 40, 50, 60, 70, 80), "geocode_threshold": 80.0},
    "generic": {},
}
PRESETS["covid"] = PRESETS["covid19"]


@dataclass(frozen=True)
class CleaningConfig:
    """Immutable settings of a cleaning run.  ``as_of`` bounds plausible dates."""

    as_of: str | None = None                 # "YYYY-MM-DD"; None skips the future-date rules
    outbreak_start: str | None = None        # None skips the before-outbreak rule
    standardize_headers: bool = True
    auto_bind: bool = True
    column_mapping: dict[str, str] = field(default_factory=dict)
    standardize_missing: bool = True
    extra_missing_tokens: tuple[str, ...] = ()
    standardize_dates: bool = True
    date_format: str = "yyyy-MM-dd"
    date_order: str = "auto"                 # auto | DMY | MDY
    compute_epi_weeks: bool = True
    geocode: bool = True
    geocode_threshold: float = 80.0
    geocode_nested: bool = False             # look names up below the place found one level up
    gazetteer_mapping: dict[str, str] = field(default_factory=dict)
    standardize_sex: bool = True
    standardize_outcomes: bool = True
    standardize_case_definitions: bool = True
    standardize_binary: bool = True
    standardize_ages: bool = True
    age_groups: bool = True
    age_breaks: tuple[int, ...] = (0, 5, 15, 30, 50, 65, 80)
    age_labels: tuple[str, ...] | None = None
    harmonize_facilities: bool = True
    facility_threshold: float = 85.0
    clean_coordinates: bool = True
    clean_phones: bool = True
    phone_country_code: str = "+221"
    validate_chronology: bool = True
    validate_demographics: bool = True
    validate_clinical: bool = True
    detect_duplicates: bool = True
    dedup_method: str = "both"               # exact | fuzzy | both | none
    dedup_action: str = "flag"               # flag | keep_first | keep_last | keep_most_complete | merge
    fuzzy_threshold: float = 0.80
    anonymize: bool = False
    anonymize_method: str = "pseudonymize"   # pseudonymize | mask | hash | drop
    anonymize_tags: tuple[str, ...] = ("full_name", "first_name", "last_name", "phone", "address", "national_id")
    hash_salt: str | None = None
    detect_alerts: bool = True
    alert_multiplier: float = 1.5
    baseline_quality: bool = True

    def with_preset(self, name: str | None, **explicit) -> "CleaningConfig":
        """Apply a preset; anything passed explicitly wins over it."""
        chosen = PRESETS.get((name or "").strip().lower(), {})
        return replace(self, **{**chosen, **explicit})


def default_session(app: str = "casewell", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the defaults the library is tuned for; cluster settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        METHOD_LIMIT: COMPILED_METHOD_LIMIT,
        # call-site capture doubles the time to build large column expressions
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def limit_method_size(spark: SparkSession) -> None:
    """Leave stages whose generated method the JVM would never compile to Spark's split code; a limit already set wins.

    Rules over many columns make such methods, and run ten times slower in them.
    """
    if spark.conf.get(METHOD_LIMIT) == DEFAULT_METHOD_LIMIT:
        spark.conf.set(METHOD_LIMIT, COMPILED_METHOD_LIMIT)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make a local one only when none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="casewell-checkpoint-"))



def keep(df: DataFrame) -> DataFrame:
    """The rows, computed once for several steps: written compressed to the checkpoint folder and read back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
