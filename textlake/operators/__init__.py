"""textlake.operators"""
