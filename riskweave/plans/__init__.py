"""Plans: named end-to-end jobs over the driver tables (catalog), backfills and serving."""
