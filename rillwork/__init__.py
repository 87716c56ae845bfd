"""Stream-segment and live-chat analytics on Spark DataFrames."""
