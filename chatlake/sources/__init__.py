"""Table scans, derived application tables, dictionaries and sinks."""
