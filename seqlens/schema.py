"""Schemas of the data model. Boxes are normalised, by centre and size, in [0, 1]."""

DETECTION = "class_id int, cx double, cy double, w double, h double, confidence double"
DETECTIONS = f"array<struct<{DETECTION.replace(' int', ': int').replace(' double', ': double')}>>"
FRAME = "frame_id string, path string, ts timestamp"
CACHED_FRAME = f"array<struct<frame_id: string, timestamp: string, detections: {DETECTIONS}>>"
CORNER_FRAME = "array<struct<filename: string, detections: array<array<double>>>>"
ENTRY = "struct<frame_idx: int, is_gap: boolean, class_id: int, cx: double, cy: double, w: double, h: double, confidence: double>"
TUBE_RECORD = f"sequence_id string, split string, label string, source string, num_frames int, tube_id int, start_frame int, end_frame int, entries array<{ENTRY}>"
PREDICTION_RECORD = "sequence_id string, label string, is_positive boolean, trigger int, score double, tube_logits array<double>, threshold double"
BOX = ("cx", "cy", "w", "h")
