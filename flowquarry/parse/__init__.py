"""Byte parsers. Each takes bytes and returns a dict, or None if they are not its protocol; none raises."""
