"""Document-recognition quality analytics as Spark DataFrame operators."""
