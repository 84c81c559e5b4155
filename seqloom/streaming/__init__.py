"""seqloom.streaming"""
