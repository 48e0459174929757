"""textlake.sources"""
