"""Column sets of the canonical formats."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical result row, in file order.
CANONICAL = [
    "competition", "round_key", "size", "discipline", "is_team_round", "rank", "start_no", "handler", "dog", "breed",
    "country", "faults", "refusals", "time_faults", "total_faults", "time", "speed", "eliminated", "judge", "sct",
    "mct", "course_length",
]
# Other header names of import files.
HEADER_SYNONYMS = {
    "size_category": "size", "handler_name": "handler", "handler_country": "country", "dog_call_name": "dog", "dog_breed": "breed",
}
# Columns of the import file format.
IMPORT_COLUMNS = [
    "round_key", "date", "size", "discipline", "is_team_round", "handler", "country", "dog", "rank", "eliminated",
    "dog_registered_name", "breed", "faults", "refusals", "time_faults", "total_faults", "time", "speed", "judge",
    "sct", "mct", "course_length", "start_no", "run_number",
]
# Leaderboard file columns.
LEADERBOARD = ["rank", "handler", "call_name", "registered_name", "size", "country", "mu", "sigma", "rating", "tier",
               "provisional", "num_runs", "finished_pct", "top3_pct", "last_competition"]


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
