"""All named queries; importing the groups fills the catalog."""

from faultlens.plans import (  # noqa: F401
    queries_augment,
    queries_evaluate,
    queries_features,
    queries_ingest,
    queries_labels,
    queries_split,
    queries_text,
    queries_train,
)
from faultlens.plans.registry import ORACLES, QUERIES  # noqa: F401
