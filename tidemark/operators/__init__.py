from .ordered import first_and_last, in_order, joined_text, number, previous, range_of, running_sum
from .partitioning import Transform, days, months
from .rowlog import RowLog, Update, compare, fold_updates, overlay
from .versioned import MAIN, ROW_ID, ReadPlan, UnknownVersion, VersionedTable

__all__ = [
    "MAIN",
    "ROW_ID",
    "ReadPlan",
    "RowLog",
    "Transform",
    "UnknownVersion",
    "Update",
    "VersionedTable",
    "compare",
    "days",
    "first_and_last",
    "fold_updates",
    "in_order",
    "joined_text",
    "months",
    "number",
    "overlay",
    "previous",
    "range_of",
    "running_sum",
]
