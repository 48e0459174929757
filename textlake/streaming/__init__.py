"""textlake.streaming"""
