"""Scalar column functions (JVM-side expressions) and the F-distribution tail."""

from panelcast.functions.scalar import *  # noqa: F401,F403
from panelcast.functions.fdist import f_upper_tail, f_sf_numpy  # noqa: F401
