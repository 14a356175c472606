"""Search, faceting and roll-up of very large file catalogs on Spark."""
