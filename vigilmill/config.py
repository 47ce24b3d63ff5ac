"""Study settings: targets, limits and labels."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the study this engine serves.
CLASS_TERMS = ["sglt2", "sglt-2", "sglt 2", "gliflozin", "gliflozins"]
FUZZY_SIMILARITY = 0.80
FUZZY_MIN_LENGTH = 7
MAX_CONTEXT_CHARS = 8000
MAX_MESSAGE_CHARS = 12000
MAX_ANCESTORS = 4
PAIR_PERCENT = 0.5
DRUG_LABELS_ZH = {"dapagliflozin": "达格列净", "empagliflozin": "恩格列净", "canagliflozin": "卡格列净", "ertugliflozin": "艾托格列净"}
POST_LABEL = "Original post (context only):"
REPLY_LABEL = "Earlier reply (context only):"
OUTCOMES = ["resolved", "improving", "ongoing", "worsening", "unknown"]

#: Alias and target lists are collected to the driver; a longer one is refused.
MOST_TARGETS = 10_000
#: Terms of a dictionary that every task may hold (about 100 bytes each).
MOST_TERMS = 500_000

NOTICE = "Counts are self-reported mentions: no incidence rates, and no evidence of causation."


@dataclass(frozen=True)
class Window:
    """A half-open study period in epoch seconds, and its communities."""

    start: int
    end: int
    communities: tuple[str, ...] = ()
