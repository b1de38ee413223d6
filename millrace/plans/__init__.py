"""From SQL text to Spark: the dialect's translation and the statements that change the catalog."""
