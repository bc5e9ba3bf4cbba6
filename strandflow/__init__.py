"""strandflow: nucleotide-sequence analytics as lazy Spark DataFrame operators."""
