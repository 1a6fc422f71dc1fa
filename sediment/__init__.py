"""A Spark-native engine for versioned key/value tables: changelogs, sorted runs, levels, compaction."""
