"""Evidence fusion for noisy readings of video frames, on Spark DataFrames."""
