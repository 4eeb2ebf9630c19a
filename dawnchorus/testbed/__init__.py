"""The check tables seen as detections, predictions, recordings and label sets."""
