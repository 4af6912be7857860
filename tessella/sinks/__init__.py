"""Writers of labels, detections, summaries and tables."""
