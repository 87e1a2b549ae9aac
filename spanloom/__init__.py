"""spanloom: Spark-native analytics over archives of timestamped transcripts."""
