"""Scans and sinks."""

from panelcast.sources.readers import *  # noqa: F401,F403
from panelcast.sources.sinks import *  # noqa: F401,F403
