"""Column functions: text, URLs, addresses, HTML."""
