"""Column functions: paths, formats, sizes, resize rules, texts and messages."""
