"""Query modules; each has QUERIES: name -> (builder, SQL or None)."""

from . import extracts, landing, monitoring, relational, reports, scoring, segments, streams, surfaces, temporal, text

MODULES = [scoring, relational, temporal, text, streams, reports, segments, monitoring, landing, surfaces, extracts]
