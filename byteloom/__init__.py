"""byteloom: byte- and text-kernel analytics as Spark columns."""
