"""Case-list cleaning, geocoding, quality and surveillance on Spark."""

from casewell.plans.jobs import (
    Bundle, analyse, audit, clean, compare, geocode_only, inspect, profile, report_tables, validate_only,
)
from casewell.settings import CleaningConfig, default_session
from casewell.sources.tabular import load_cases, load_gazetteer

__all__ = ["Bundle", "CleaningConfig", "analyse", "audit", "clean", "compare", "default_session", "geocode_only",
           "inspect", "load_cases", "load_gazetteer", "profile", "report_tables", "validate_only"]
