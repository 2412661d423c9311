"""maskwork: find, hide and restore personal data in collections of text, on Spark."""
