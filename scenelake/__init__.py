"""Scene-graph analytics as Spark plans."""
