"""Plans: derived corpora built from the driver tables, and the registered queries."""
