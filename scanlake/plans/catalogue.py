"""All registered queries."""

from scanlake.plans import (  # noqa: F401
    content, counting, history, ingest, projects, streams, summaries, verdicts,
)
from scanlake.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
