"""Every query of the library outside the corpus subpackage, by name."""

from __future__ import annotations

from millrace.functions import scalar, udfs
from millrace.plans import aggregation, relational, windows
from millrace.sources import formats
from millrace.streaming import streams

QUERIES = {}
ORACLES = {}
for module in (formats, relational, aggregation, windows, scalar, udfs, streams):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
