"""Every registered query of the library and its SQL."""

from tarnwatch.plans import alignment, evaluation, files, learning, scalars, spatial, streams

MODULES = (alignment, evaluation, spatial, scalars, learning, streams, files)
QUERIES: dict = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLES: dict = {n: s for m in MODULES for n, s in m.ORACLES.items()}
