"""File-source streams: upsert by id and append by day."""
