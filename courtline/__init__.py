"""League analytics on Spark: stints, ratings, spacing, fatigue, odds, backtests."""
