"""Named queries over the driver tables and their DuckDB twins."""

from . import answers, assembled, keyworded, stored, tabular, textual

QUERIES = tabular.QUERIES | textual.QUERIES | assembled.QUERIES | stored.QUERIES | answers.QUERIES | keyworded.QUERIES
ORACLES = tabular.ORACLES | textual.ORACLES | assembled.ORACLES | stored.ORACLES | answers.ORACLES | keyworded.ORACLES
