"""Network-flow intrusion analytics as Spark DataFrame operators."""
