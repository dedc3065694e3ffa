"""Filter language: text to syntax tree to Spark Column."""
