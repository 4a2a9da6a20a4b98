"""seqlens: Spark DataFrame operators for object detections observed over time."""
