"""sluice: text routing, dataset curation and corpus preparation on Spark DataFrames."""
