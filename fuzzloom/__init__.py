"""fuzzloom: fuzzy-rule analytics as Spark plans."""
