"""Social-graph analytics and corpus preparation on Spark."""
