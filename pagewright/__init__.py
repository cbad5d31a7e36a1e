"""Web-evidence analytics on Spark: pages, link graphs, fetch logs and agent transcripts as DataFrames."""
