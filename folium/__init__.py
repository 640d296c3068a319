"""Folium: a Spark-native engine that analyses and converts word-processing and HTML documents at scale."""

__version__ = "0.1.0"
