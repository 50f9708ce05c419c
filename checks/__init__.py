"""Queries over the given tables, each with the SQL that must give the same rows.

The tables hold no hydrology, so they are read in its shape: events are gauge
readings, suppliers are gauging sites or watersheds, customers weather stations,
orders grid cells or dated records.
"""

from checks import core, jobs, landed, models, ranges, spatial  # noqa: F401  (registers the queries)
from checks.base import QUERIES, SQL  # noqa: F401
