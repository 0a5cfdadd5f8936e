"""labelflow: labelled-text dataset engineering on Spark DataFrames."""

from labelflow.operators.frames import Frames
from labelflow.session import configure, get_spark

__all__ = ["Frames", "configure", "get_spark"]
