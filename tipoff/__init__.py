"""Season analytics on Spark: histories, peer statistics, matching, rolling evaluation and risk boards."""
