"""All queries of the library with their DuckDB counterparts."""

from __future__ import annotations

from spectraloom.plans import charge_grids, detection, formats, inventory, original, quant, relational, sequences, spectra_match, stores, tables

PARTS = (charge_grids, formats, quant, relational, sequences, inventory, stores, tables, spectra_match, original, detection)
QUERIES = {name: q for part in PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: q for part in PARTS for name, q in part.ORACLES.items()}
