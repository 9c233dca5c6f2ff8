"""Sources and sinks: frame files, schemas as JSON, and Arrow-backed readers."""
