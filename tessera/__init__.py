"""A Spark-native engine for collected announcements: observations, text, dates, entities, snapshots."""
