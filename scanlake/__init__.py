"""scanlake: fleet-scale analytics over scanner, test, coverage and build reports, on Spark."""
