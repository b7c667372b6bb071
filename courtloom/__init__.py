"""courtloom: multi-camera observation analytics written as Spark DataFrame operators."""
