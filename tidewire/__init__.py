"""Tidewire: Spark-native operators for news-like content feeds."""
