"""Trajectories, tracklet graphs and collective measures of many individuals, as Spark DataFrames."""
