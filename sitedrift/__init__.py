"""Spark jobs that track how web sites change: URL inventories, candidates, alerts, summaries and feeds."""
