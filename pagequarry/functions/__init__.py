"""Column functions: text, URLs and DOIs, HTML, names, fuzzy ratios."""
