"""Data contracts on Spark: audits, evolution, diffs, policies and views."""
