"""Sources, sinks and the schema catalog."""
