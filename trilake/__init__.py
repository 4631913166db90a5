"""Graph data on Spark: triples, patterns, property graphs, measurement logs. See README.md."""
