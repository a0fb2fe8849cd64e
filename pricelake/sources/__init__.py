"""Tables, archives and the parsers of archived payloads."""
