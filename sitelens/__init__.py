"""Turn tables of captured web pages into clean, deduplicated records with Spark."""
