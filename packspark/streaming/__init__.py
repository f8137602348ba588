"""packspark.streaming"""
