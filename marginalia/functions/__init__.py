"""Pure text and Markdown functions and their Arrow UDFs."""
