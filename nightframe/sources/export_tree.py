"""Which files of an export folder may be read, and what each one is. Denied folders are never listed."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import SparkSession

from nightframe.sources import files

# Folders and name parts that must not be read.
DENIED_FOLDERS = (
    "Your Profile", "Account", "Security", "Notifications", "Social", "Fitbit Friends", "Blocked Users", "Commerce", "Discover",
    "Surveys", "Premium", "Guided Programs", "Stress Journal",
)
DENIED_NAMES = (
    "gps_location_", "live_pace_", "UserDemographicData", "UserProfileData", "UserLocationCountry", "MedicalRecords", "UserJournalEntries",
    "UserFoodFrequencyEntries", "UserConversations",
)
DENIED_FILE = "daily_heart_rate_zones.csv"
OPT_IN_FOLDER = "Menstrual Health"

WINDOWS, SERIES = "windows", "series"


@dataclass(frozen=True)
class Kind:
    """Files of one metric: ``stem`` then a date, anything, or nothing (``tail``), then the suffix."""

    folder: str
    stem: str
    tail: str
    suffix: str
    metric: str
    phase: str

    def matches(self, path: str) -> bool:
        folder, _, name = path.rpartition("/")
        if folder != self.folder or not name.startswith(self.stem) or not name.endswith(self.suffix):
            return False
        middle = name[len(self.stem) : len(name) - len(self.suffix)]
        return bool(re.fullmatch({"date": r"\d{4}-\d{2}-\d{2}", "any": r"[^/]+", "": ""}[self.tail], middle))


_GLOBAL, _HRV, _SPO2 = "Global Export Data", "Heart Rate Variability", "Oxygen Saturation (SpO2)"
# What may be read.
KINDS = (
    Kind(_GLOBAL, "sleep-", "date", ".json", "sleep", WINDOWS),
    Kind("Sleep Score", "sleep_score", "", ".csv", "sleep_score", WINDOWS),
    Kind("Health Fitness Data_GoogleData", "UserSleeps_", "any", ".csv", "user_sleeps", WINDOWS),
    Kind(_GLOBAL, "resting_heart_rate-", "date", ".json", "resting_hr", WINDOWS),
    Kind(_GLOBAL, "time_in_heart_rate_zones-", "date", ".json", "hr_zones", WINDOWS),
    Kind("Daily Readiness", "Daily Readiness Score - ", "any", ".csv", "readiness", WINDOWS),
    Kind("Stress Score", "Stress Score", "", ".csv", "stress", WINDOWS),
    Kind(_HRV, "Daily Heart Rate Variability Summary - ", "any", ".csv", "hrv_summary", WINDOWS),
    Kind(_HRV, "Daily Respiratory Rate Summary - ", "any", ".csv", "resp_rate_daily", WINDOWS),
    Kind(_HRV, "Respiratory Rate Summary - ", "any", ".csv", "resp_rate_stage", WINDOWS),
    Kind("Active Zone Minutes (AZM)", "Active Zone Minutes - ", "any", ".csv", "azm", WINDOWS),
    Kind(_GLOBAL, "steps-", "date", ".json", "steps", WINDOWS),
    Kind(_GLOBAL, "very_active_minutes-", "date", ".json", "active_minutes", WINDOWS),
    Kind(_GLOBAL, "moderately_active_minutes-", "date", ".json", "active_minutes", WINDOWS),
    Kind(_GLOBAL, "lightly_active_minutes-", "date", ".json", "active_minutes", WINDOWS),
    Kind("Temperature", "Computed Temperature - ", "any", ".csv", "temperature", WINDOWS),
    Kind(_SPO2, "Daily SpO2 - ", "any", ".csv", "spo2_daily", WINDOWS),
    Kind(_SPO2, "Minute SpO2 - ", "any", ".csv", "spo2_minute", SERIES),
    Kind(_HRV, "Heart Rate Variability Details - ", "any", ".csv", "hrv_details", SERIES),
    Kind("Snore and Noise Detect", "Snore Details - ", "any", ".csv", "snore", SERIES),
    Kind(_GLOBAL, "heart_rate-", "date", ".json", "heart_rate", SERIES),
)


def is_denied_folder(path: str, opt_in: bool = False) -> bool:
    top = path.strip("/").split("/")[0]
    return top in DENIED_FOLDERS or (top == OPT_IN_FOLDER and not opt_in)


def classify(path: str, opt_in: bool = False) -> str:
    """denied, allowed or ignored; denial comes first and what nothing names is ignored. Paths that climb are denied."""
    parts = path.split("/")
    if ".." in parts or path.startswith("/") or "\\" in path:
        return "denied"
    if is_denied_folder(path, opt_in) and len(parts) > 1:
        return "denied"
    if parts[-1] == DENIED_FILE or any(p.startswith(DENIED_NAMES) for p in parts[1:]):
        return "denied"
    return "allowed" if describe(path) else "ignored"


def describe(path: str) -> Kind | None:
    return next((k for k in KINDS if k.matches(path)), None)


@dataclass(frozen=True)
class ExportFile:
    path: str
    relative: str
    size: int
    kind: Kind


def enumerate_export(spark: SparkSession, root: str, opt_in: bool = False) -> list[ExportFile]:
    """Readable files under ``root``, by path, on any file system; denied folders are left out before they are opened."""
    found, waiting = [], [("", root)]
    while waiting:
        above, folder = waiting.pop()
        for name, path, is_folder, size in files.children(spark, folder):
            relative = f"{above}{name}"
            if is_folder:
                if not is_denied_folder(relative, opt_in):
                    waiting.append((f"{relative}/", path))
            elif classify(relative, opt_in) == "allowed":
                found.append(ExportFile(path, relative, size, describe(relative)))
    return sorted(found, key=lambda f: f.relative)


def scan_summary(found: list[ExportFile]) -> dict[str, int]:
    return dict(Counter(f.kind.metric for f in found))
