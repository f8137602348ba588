"""packspark.functions"""
