"""Network-fragmentation analytics and data preparation on Spark."""
