"""Sources and sinks: captured payloads in, items out; daily exports and reports."""
