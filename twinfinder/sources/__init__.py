"""Tables, files, logs, the catalog and reports."""
