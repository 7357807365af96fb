"""Named queries over the driver's tables; importing this package fills the registry."""

from quillstone.plans import (  # noqa: F401
    extension,
    functions,
    ledger,
    membership,
    metrics,
    prefix,
    qos,
    routing,
    security,
    sketch,
    streams,
    substrate,
    tiers,
)
from quillstone.plans.registry import ORACLES, QUERIES  # noqa: F401
