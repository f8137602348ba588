"""packspark.sources"""
