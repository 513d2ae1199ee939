"""All registered queries; importing the modules fills the registry."""

from hirespan.plans import candidates, feeds, ingest, percentiles, streams, texts, upkeep  # noqa: F401
from hirespan.plans.registry import ORACLES, QUERIES  # noqa: F401
