"""Sources: reading driver tables and feature/score stores with explicit schemas and pushdown."""
