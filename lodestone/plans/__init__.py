"""Query registries: (spark, data directory) -> DataFrame, with an equivalent SQL text where SQL can state it."""
