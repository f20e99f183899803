"""Named queries over the driver tables, one module for each block of operators."""

from terrane.plans import classification, estimation, learned, monitoring, reports, scalars, search, series, similarity, streams  # noqa: F401
from terrane.plans.catalogue import QUERIES, SQL  # noqa: F401
