"""Sales mart on Spark: star schema, dated snapshots and sales reports as DataFrames."""
