"""Table scans, stored-body parsers and sinks."""
