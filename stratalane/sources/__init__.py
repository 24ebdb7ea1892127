"""Sources and sinks of encoded columns."""
