"""Spark-native analytics of video-derived 3D scenes: frames, cameras, point clouds and run records."""
