"""Text codes of job functions, and blank text, as SQL text."""

from __future__ import annotations

# Job functions that are planned together, and the name they are planned under.
MERGED_FUNCTIONS = ("AR", "HW", "OP", "RF", "RX")
MERGED_NAME = "RH"
RENAMED_FUNCTION = "PV"
RENAMED_NAME = "E4"

INVALID_CODE_MESSAGE = "Invalid project code!!"
UNKNOWN_UNIT_MESSAGE = "Not a known unit"


def planning_function(code: str) -> str:
    """Function a job code is planned under."""
    merged = ", ".join(f"'{c}'" for c in MERGED_FUNCTIONS)
    return (
        f"CASE WHEN {code} IN ({merged}) THEN '{MERGED_NAME}' "
        f"WHEN {code} = '{RENAMED_FUNCTION}' THEN '{RENAMED_NAME}' ELSE {code} END"
    )


def is_filled(text: str) -> str:
    """True for text that is neither missing nor blank; never NULL."""
    return f"trim(coalesce({text}, '')) <> ''"
