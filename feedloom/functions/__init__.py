"""Column functions: text, HTML, URLs, dates, JSON paths and labels."""
