"""All registered queries; importing this package fills the registry."""

from medgrain.queries import aggregates, chain, filters, functions, jobs, joins, models, sources, windows  # noqa: F401
from medgrain.queries.registry import REGISTRY  # noqa: F401
