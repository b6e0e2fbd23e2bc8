"""Sources and sinks of code corpora."""
