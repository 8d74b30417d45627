"""Preparing, fusing, classifying and evaluating posts with text and image features on Spark."""

__version__ = "0.1.0"
