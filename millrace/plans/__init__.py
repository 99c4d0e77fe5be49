"""Gates, execution and analysis of SQL text through the Catalyst parser."""
