"""keytide: analytics over replicated command logs and keyed state, on Spark."""
