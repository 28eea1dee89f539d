"""Log, event and metric analytics as functions from DataFrame to DataFrame."""
