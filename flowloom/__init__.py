"""Network-traffic dataset engine built from Spark DataFrame operators."""
